"""Counts, ratios, rankings and buckets. All top-k orders are total, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.functions.text import bar_width, percent, truthy

UNDEFINED = "undefined"
PRIORITIES = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def group_counts(df: DataFrame, key: str, name: str = "n", skip_absent: bool = True) -> DataFrame:
    """Rows of each key; absent keys are left out, or counted as `undefined`."""
    value = F.col(key).cast("string")
    rows = df.where(truthy(value)) if skip_absent else df
    return rows.groupBy((value if skip_absent else F.coalesce(value, F.lit(UNDEFINED))).alias(key)).agg(F.count("*").alias(name))


def top_counts(df: DataFrame, key: Column, k: int, alias: str, tie: Column | None = None, name: str = "n") -> DataFrame:
    """The k most frequent keys. Ties go by the smallest `tie` of the key's rows (first seen), else by the key."""
    counted = df.groupBy(key.alias(alias)).agg(F.count("*").alias(name), F.min(tie if tie is not None else key).alias("__tie"))
    return counted.orderBy(F.desc(name), "__tie", alias).limit(k).drop("__tie")


def top_elements(df: DataFrame, array: Column, k: int, alias: str, tie: Column | None = None, name: str = "n") -> DataFrame:
    """The k most frequent elements of an array column; a null array is empty."""
    if tie is None:
        return top_counts(df.select(F.explode(array).alias("__e")), F.col("__e"), k, alias, name=name)
    opened = df.select(tie.alias("__ord"), F.posexplode(array).alias("__pos", "__e"))
    return top_counts(opened, F.col("__e"), k, alias, F.struct("__ord", "__pos"), name)


def top_named(df: DataFrame, key: Column, k: int, names: DataFrame, name_key: str, name: str, alias: str = "key") -> DataFrame:
    """The k most frequent keys, null as `undefined`, with the name each has in a dictionary, or the key itself. The lookup is after the limit."""
    top = top_counts(df, F.coalesce(key.cast("string"), F.lit(UNDEFINED)), k, alias)
    said = names.groupBy(F.col(name_key).cast("string").alias("__k")).agg(F.min(name).alias("__name"))
    return top.join(said, F.col(alias) == F.col("__k"), "left").select(alias, "n", F.coalesce("__name", alias).alias("name"))


def distinct_values(key: Column, sentinel: object = UNDEFINED) -> Column:
    """Distinct values, null being one of them."""
    return F.count_distinct(F.coalesce(key.cast("string"), F.lit(sentinel)))


def distinct_present(key: Column) -> Column:
    return F.count_distinct(F.when(truthy(key.cast("string")), key))


def list_size(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def share(part: Column) -> Column:
    """Rounded percentage of rows for which part holds; 0 over no rows."""
    return percent(F.count_if(part), F.count("*"))


def floor_max(value: Column, least: float = 0.0) -> Column:
    return F.greatest(F.max(value), F.lit(least))


def map_total(m: Column) -> Column:
    """Sum over a map's values, 1 where that is 0: a denominator."""
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.coalesce(F.nullif(total, F.lit(0)), F.lit(1)).cast("long")


def supplied_or(supplied: Column, computed: Column) -> Column:
    """A supplied statistic wins unless it is null; 0 is kept."""
    return F.coalesce(supplied, computed)


def priority_rank(priority: Column) -> Column:
    """Order of the buckets; unknown priorities are medium."""
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, F.coalesce(priority, F.lit(""))), F.lit(PRIORITIES["medium"]))


def buckets(df: DataFrame, rank: Column, order: str) -> DataFrame:
    """Rows with the rank of their bucket, bucket by bucket in the given order: a distributed sort, whatever a bucket's size."""
    return df.withColumn("rank", rank).orderBy("rank", order)


def bucket_page(df: DataFrame, rank: Column, order: str, value: str, most: int, alias: str = "members") -> DataFrame:
    """(rank, n, members): buckets that have rows, with their size and their first `most` members for a page."""
    ranked = df.select(rank.alias("rank"), F.col(order).alias("__o"), F.col(value).alias("__v"))
    place = F.row_number().over(Window.partitionBy("rank").orderBy("__o", "__v"))
    first = ranked.withColumn("__p", place).where(F.col("__p") <= most)
    lists = first.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__v"))), lambda s: s["__v"]).alias(alias))
    return ranked.groupBy("rank").agg(F.count("*").alias("n")).join(lists, "rank")


def has_rows(*frames: DataFrame) -> bool:
    """Any row in any of the frames; at most one row of each is read."""
    return any(not f.isEmpty() for f in frames)


def bar_widths(counts: DataFrame, n: str, name: str = "width") -> DataFrame:
    """Width of each bar against the largest; the maximum is joined as one row, not windowed in one task."""
    most = counts.agg(F.max(n).alias("__most"))
    return counts.crossJoin(F.broadcast(most)).withColumn(name, bar_width(F.col(n), F.col("__most"))).drop("__most")


def hourly(df: DataFrame, ts: str, name: str = "n") -> DataFrame:
    """Rows of each hour from the first to the last, hours without rows included, and whether the hour is the peak."""
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    counts = df.where(F.col(ts).isNotNull()).groupBy(hour.alias("hour")).agg(F.count("*").alias(name))
    span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b"), F.max(name).alias("peak")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"), "peak")
    filled = every.join(counts, "hour", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return filled.select("hour", name, (F.col(name) == F.col("peak")).alias("is_peak"))


def top_chains(df: DataFrame, first: Column, score: str, key: str, k: int = 3) -> DataFrame:
    """Rows for which `first` holds lead, then by falling score (null as 0), then by key; no status filter."""
    return df.orderBy(F.coalesce(first, F.lit(False)).desc(), F.coalesce(F.col(score), F.lit(0.0)).desc(), key).limit(k)


def recent(df: DataFrame, wanted: Column, ts: str, key: str, k: int = 6) -> DataFrame:
    return df.where(wanted).orderBy(F.col(ts).desc_nulls_last(), key).limit(k)


def newest_first(df: DataFrame, ts: str, key: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), key)


def tail_of(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each group with their place among them, 1 the oldest."""
    down = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("__r", F.row_number().over(down)).where(F.col("__r") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).drop("__r")


def scaled(df: DataFrame, value: str, name: str = "scaled") -> DataFrame:
    """Min-max scaling; a flat series is 0."""
    ends = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    span = F.nullif(F.col("__b") - F.col("__a"), F.lit(0))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.coalesce((F.col(value) - F.col("__a")) / span, F.lit(0.0))).drop("__a", "__b")
