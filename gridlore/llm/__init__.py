"""Operators for preparing language-model training data; nothing else in gridlore imports this package."""
