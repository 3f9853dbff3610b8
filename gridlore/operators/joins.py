"""Joins between chains, alerts, logs, mitigations, threads and dictionaries.

Membership joins explode the array first: as a condition, array_contains would plan a Cartesian product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dictionary of at most so many rows and bytes (as JSON) is broadcast; a larger one is joined by shuffle.
SMALL_ROWS, SMALL_BYTES = 10_000, 8 << 20


def first_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; a hot key is combined before it is shuffled."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row")).select("__row.*")


def small(dimension: DataFrame) -> DataFrame:
    """The dictionary, hinted for broadcast if it really is small."""
    some = dimension.limit(SMALL_ROWS + 1).select(F.octet_length(F.to_json(F.struct(*dimension.columns))).alias("b"))
    rows, size = some.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(dimension) if rows <= SMALL_ROWS and size <= SMALL_BYTES else dimension


def with_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, child_id: str, name: str = "message_count") -> DataFrame:
    """Parents with the number of their children, 0 without any. Children are counted before the join."""
    counts = children.where(F.col(child_id).isNotNull()).groupBy(F.col(child_key).alias("__key")).agg(F.count(child_id).alias(name))
    return parents.join(counts, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def to_one(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[str], take: dict[str, str]) -> DataFrame:
    """Left rows with columns of the first right row of the key (chain of an alert, alert of a log); no match: null."""
    one = first_by(right, right_key, order).select(F.col(right_key).alias("__key"), *[F.col(c).alias(n) for c, n in take.items()])
    return left.join(one, F.col(left_key) == F.col("__key"), "left").drop("__key")


def to_many(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, name: str) -> DataFrame:
    """Left rows with the sorted list of a right column (logs of an alert, alerts of a chain); no match: empty.

    A list holds all of its parent's children: for parents with more than some thousands take pages.paged.
    """
    lists = right.groupBy(F.col(right_key).alias("__key")).agg(F.sort_array(F.collect_list(value)).alias(name))
    out = left.join(lists, F.col(left_key) == F.col("__key"), "left").drop("__key")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def by_membership(left: DataFrame, array: str, right: DataFrame, right_key: str) -> DataFrame:
    """Pairs of left rows and the right rows whose key is in the left row's array; repeats in the array don't multiply."""
    opened = left.withColumn("__key", F.explode(F.array_distinct(F.coalesce(F.col(array), F.array().cast(left.schema[array].dataType)))))
    return opened.join(right, F.col("__key") == F.col(right_key)).drop("__key")


def alert_mitigations(alerts: DataFrame, chains: DataFrame, mitigations: DataFrame) -> DataFrame:
    """(alert_id, mitigation_id): the alert's chain must exist, be the mitigation's chain, and the mitigation name the alert."""
    named = mitigations.select(F.col("id").alias("mitigation_id"), F.col("chainId").alias("m_chain"), F.explode(F.array_distinct("alertIds")).alias("m_alert"))
    known = alerts.select(F.col("id").alias("alert_id"), "chainId").join(chains.select(F.col("id").alias("chainId")).distinct(), "chainId", "left_semi")
    return known.join(named, (F.col("m_chain") == F.col("chainId")) & (F.col("m_alert") == F.col("alert_id"))).select("alert_id", "mitigation_id")


def with_dimension(df: DataFrame, dimension: DataFrame, key: str, dim_key: str, take: dict[str, str], defaults: dict[str, object], order: list[str] | None = None) -> DataFrame:
    """Dictionary lookup; a miss takes the default, which is the key itself where it is None.

    Of the rows of a repeated key the first in `order` counts, by default the one of the smallest columns taken.
    """
    first = first_by(dimension.where(F.col(dim_key).isNotNull()), dim_key, order or list(take))
    one = small(first.select(F.col(dim_key).alias("__key"), *[F.col(c).alias(n) for c, n in take.items()]))
    out = df.join(one, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumns({n: F.coalesce(F.col(n), F.col(key).cast("string") if defaults[n] is None else F.lit(defaults[n])) for n in take.values() if n in defaults})


def without(df: DataFrame, tombstones: DataFrame, key: str, dead_key: str) -> DataFrame:
    return df.join(tombstones.select(F.col(dead_key).alias("__dead")).distinct(), F.col(key) == F.col("__dead"), "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, tombstones: DataFrame, key: str, child_key: str, dead_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the deleted parents and all of theirs."""
    return without(parents, tombstones, key, dead_key), without(children, tombstones, child_key, dead_key)
