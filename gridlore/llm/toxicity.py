"""Toxicity by multiple-instance learning.

Only documents carry labels. Each sentence gets a probability from its words; a document's probability is their
noisy-or, 1 - prod(1 - p). Training follows the gradient of the document log-likelihood through the noisy-or, so the
weights end up on the words of the sentences that explain the label, and the same sentence scores locate them.

Words and their 4- and 6-letter beginnings are features, so inflected forms that no training document had still count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import read, staged

TRAIN_DOCS = 20_000  # bound of the labelled rows the classifier is fitted on, in expectation
MAX_FEATURES = 20_000  # features kept by screening
MIN_POSITIVE, MIN_LIFT = 3, 3.0  # labelled-toxic documents a feature must be in, and its share there against elsewhere
FLUSH = 300_000  # distinct features a task counts before it emits them
EPOCHS, RATE, L2 = 300, 0.2, 2e-4
CACHE_WORDS = 400_000

TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
ENDS = frozenset(".!?\n")


def word_features(word: str) -> list[str]:
    """The word and, where it is longer, its beginnings."""
    out = [word]
    if len(word) > 4:
        out.append(f"4 {word[:4]}")
    if len(word) > 6:
        out.append(f"6 {word[:6]}")
    return out


@dataclass(frozen=True)
class Model:
    bias: float
    weight: dict[str, float]


class Scorer:
    """Sentence and document probabilities under a model; the weight of each word seen is remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _weights(self, tokens: list[str]) -> np.ndarray:
        known, weight = self.known, self.model.weight
        if len(known) > CACHE_WORDS:
            known.clear()
        for t in [t for t in set(tokens) if t not in known]:
            known[t] = math.nan if t[0] in ENDS else sum(weight.get(f, 0.0) for f in word_features(t))
        return np.fromiter(map(known.__getitem__, tokens), float, len(tokens))

    def sentences(self, text: str | None) -> np.ndarray:
        """The probability of each sentence that has a word."""
        tokens = TOKEN.findall((text or "").lower())
        if not tokens:
            return np.empty(0)
        w = self._weights(tokens)
        end = np.isnan(w)
        at = np.cumsum(end)
        words = np.bincount(at, ~end)
        z = np.bincount(at, np.where(end, 0.0, w))[words > 0] + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def document(self, text: str | None) -> float:
        p = self.sentences(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, str, float]]:
        """(number, sentence, probability) of the sentences with a word that reach `least`."""
        found, number, text = [], 0, text or ""
        for m in re.finditer(r"[^.!?\n]+", text):
            p = self.sentences(m[0])
            if len(p):
                if p[0] >= least:
                    found.append((number, m[0].strip(), float(p[0])))
                number += 1
        return found


def _documents(text: str) -> list[list[str]]:
    """Features of each sentence of a text that has a word."""
    out: list[list[str]] = [[]]
    for t in TOKEN.findall(text.lower()):
        if t[0] in ENDS:
            out.append([])
        else:
            out[-1] += word_features(t)
    return [s for s in out if s]


def screened(train: DataFrame) -> dict[str, float]:
    """Features that toxic documents have far more often than others, with their log lift. train: text, toxic."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            keys = list(n[0].keys() | n[1].keys())
            out = pd.DataFrame({"feature": keys, "neg": [n[0][k] for k in keys], "pos": [n[1][k] for k in keys]})
            n[0].clear(), n[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                n[int(toxic)].update({f for w in set(TOKEN.findall((text or "").lower())) for f in word_features(w)})
                if len(n[0]) + len(n[1]) > FLUSH:
                    yield flush()
        if n[0] or n[1]:
            yield flush()

    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return {}
    counts = train.mapInPandas(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    lift = ((F.col("pos") + 0.5) / (size[1] + 1)) / ((F.col("neg") + 0.5) / (size[0] + 1))
    best = counts.withColumn("lift", lift).where((F.col("pos") >= MIN_POSITIVE) & (F.col("lift") >= MIN_LIFT)).orderBy(F.desc(F.col("pos") * F.log("lift")), "feature").limit(MAX_FEATURES)
    return {r["feature"]: math.log(r["lift"]) for r in best.select("feature", "lift").collect()}


def fit(train: DataFrame) -> Model:
    """Model from rows (text, toxic 0/1), at most about TRAIN_DOCS of them. Fewer than two classes: scores of 0."""
    lifts = screened(train)
    if not lifts:
        return Model(-30.0, {})
    number = {f: k for k, f in enumerate(lifts)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                said = _documents(text or "")
                hits = [x for s in said if (x := [number[f] for f in s if f in number])]
                rows.append((int(toxic), len(said) - len(hits), [len(x) for x in hits], [k for x in hits for k in x]))
            yield pd.DataFrame(rows, columns=["toxic", "plain", "sizes", "features"])

    rows = train.mapInPandas(encode, "toxic int, plain int, sizes array<int>, features array<int>").collect()
    y = np.array([r["toxic"] for r in rows], float)
    plain = np.array([r["plain"] for r in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(r["sizes"]) for r in rows])
    sent = np.repeat(np.arange(len(doc)), np.array([n for r in rows for n in r["sizes"]], int))
    feature = np.array([k for r in rows for k in r["features"]], int)
    return Model(*descend(y, plain, doc, sent, feature, np.array(list(lifts.values())), list(lifts)))


def slope(w: np.ndarray, b: float, y: np.ndarray, plain: np.ndarray, doc: np.ndarray, sent: np.ndarray, feature: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The loss (log-loss of the noisy-or and a weight penalty) and its gradient in w and b."""
    z = b + np.bincount(sent, w[feature], len(doc))
    p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + math.exp(-b))
    none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + plain * math.log1p(-p0)  # log of "no sentence is toxic"
    some = np.maximum(-np.expm1(none), 1e-9)
    pull = np.where(y > 0, -np.exp(none) / some, 1.0) / len(y)  # d loss / d z of a sentence is pull x p
    gz = pull[doc] * p
    penalty = L2 / max(1, len(w)) ** 0.5
    loss = -np.where(y > 0, np.log(some), none).mean() + penalty * (w @ w) / 2
    return float(loss), np.bincount(feature, gz[sent], len(w)) + penalty * w, float(gz.sum() + (pull * plain).sum() * p0)


def descend(y: np.ndarray, plain: np.ndarray, doc: np.ndarray, sent: np.ndarray, feature: np.ndarray, lift: np.ndarray, names: list[str]) -> tuple[float, dict[str, float]]:
    """Adam on the mean log-loss of the noisy-or. doc, sent: the document of each sentence, the sentence of each feature."""
    w, b = 0.5 * lift, -7.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, EPOCHS + 1):
        _, g, gb = slope(w, b, y, plain, doc, sent, feature)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - RATE * fix * m / (np.sqrt(v) + 1e-8)
        b = b - RATE * fix * mb / (math.sqrt(vb) + 1e-8)
    return float(b), dict(zip(names, w.tolist()))


def held_out(doc_id: Column, modulus: int = 5, remainder: int = 0) -> Column:
    """crc32 of the id as text; a null id has none and is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic) of labelled rows that aren't held out, thinned by a hash of the id to `most` rows in expectation.

    Null labels are left out; an id with several labels is toxic if one says so. Repeated rows count once; the different
    texts of one id are rows of their own, thinned together with all others.
    """
    truth = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most / max(1, truth.count()))
    chosen = truth.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = body.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).alias("toxic"))
    rows = staged(rows.groupBy("doc_id", F.xxhash64("text").alias("__row")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-labelled")
    # one id may stand for many texts: thinned again by id and text, so what is fitted stays bounded
    again = min(1.0, most / max(1, rows.count()))
    thin = F.pmod(F.xxhash64("__row", "doc_id"), F.lit(1 << 30)) < int(again * (1 << 30))
    return rows.where(thin).select("text", "toxic")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` added; null and empty texts have no sentence and score 0. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series([scorer.document(t) for t in batch], dtype=float)

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text)))


def locate(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with `offending`: array of (number, sentence, probability), empty where no sentence reaches `least`. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series([[{"number": n, "sentence": s, "probability": p} for n, s, p in scorer.offending(t, least)] for t in batch])

    return docs.withColumn("offending", F.pandas_udf(run, "array<struct<number:int,sentence:string,probability:double>>")(F.col(text)))


def op2_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, read(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
