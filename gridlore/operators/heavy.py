"""Exact top k from a sketch's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.operators.kpis import top_counts

TRACKED = 10_000  # keys that a sketch follows: some hundred kB, whatever the data


def candidates(df: DataFrame, key: str, tracked: int = TRACKED) -> tuple[list[object], int, int]:
    """(keys, most, rows): keys that may be frequent, and how often any other key can occur at most.

    The sketch's map holds tracked / 0.75 keys or more and so errs by at most 3.5 / (tracked / 0.75) of the rows a key. It
    returns the keys whose certain count is over that error; so any other occurs at most twice as often as the error.
    """
    found, rows = df.agg(F.expr(f"approx_top_k({key}, {tracked}, {tracked})"), F.count("*")).first()
    return [r["item"] for r in found], int(2 * 3.5 * 0.75 * rows / tracked) + 1, rows


def exact_top(df: DataFrame, key: Column, k: int, alias: str, tie: Column | None = None, name: str = "n", tracked: int = TRACKED) -> tuple[DataFrame, bool]:
    """(the k most frequent keys as top_counts has them, whether the candidates were enough).

    Candidates alone are counted exactly, by a broadcast of `tracked` keys at most. They are enough if they have all rows
    between them, or if the k-th of them occurs more often than any other key can; else all keys are counted. A null key is
    not counted by sketches: give a key that is never null.
    """
    rows = df.withColumn("__key", key).withColumn("__order", tie if tie is not None else F.col("__key"))
    keys, most, total = candidates(rows, "__key", tracked)
    few = df.sparkSession.createDataFrame([(x,) for x in keys], rows.select("__key").schema)
    counted = rows.join(F.broadcast(few), "__key", "left_semi").groupBy(F.col("__key").alias(alias)).agg(F.count("*").alias(name), F.min("__order").alias("__tie"))
    counts = sorted((r[name] for r in counted.select(name).collect()), reverse=True)  # of `tracked` keys at most
    if sum(counts) == total or (len(counts) >= k and counts[k - 1] > most):
        return counted.orderBy(F.desc(name), "__tie", alias).limit(k).drop("__tie"), True
    return top_counts(df, key, k, alias, tie, name), False
