"""Exact distinct counts that add up: bitmaps of values, kept by hour, tenant or what else, and joined by OR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.operators.ordinals import numbered_all


def numbered_values(df: DataFrame, value: str, name: str = "number") -> DataFrame:
    """(value, number): a dense number from 1 for each value that isn't null, for values that aren't whole numbers."""
    return numbered_all(df.select(value).where(F.col(value).isNotNull()).distinct(), value, name=name)


def presence(df: DataFrame, number: Column, **by: Column) -> DataFrame:
    """(by..., bucket, bits): the numbers of each group, 32,768 a bitmap; null is a value of its own, with a null bucket.

    What is stored grows with distinct numbers a group, not with rows; bits are set before anything is shuffled.
    """
    keyed = df.select(*[c.alias(n) for n, c in by.items()], number.cast("long").alias("__n"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("__n")).alias("bits")
    return keyed.groupBy(*by, F.bitmap_bucket_number("__n").alias("bucket")).agg(bits)


def distinct_counts(stored: DataFrame, *by: str, name: str = "n", null_counts: bool = True) -> DataFrame:
    """(by..., n): distinct values of each group, from bitmaps of groups at least as fine; null counts as one value, or not at all."""
    parts = stored.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("__n"))
    one = F.when(F.col("bucket").isNotNull(), F.col("__n")).otherwise(F.lit(int(null_counts)).cast("long"))
    return parts.groupBy(*by).agg(F.coalesce(F.sum(one), F.lit(0).cast("long")).alias(name))
