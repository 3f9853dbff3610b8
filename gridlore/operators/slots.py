"""The last hours of each tenant: a fixed number of counts and their peak, from batches or from a stream's windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 24
HOUR = 3600


def hour_of(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / HOUR)


def age_in_hours(ts: Column, now: Column) -> Column:
    """0 in the hour of now, 1 in the one before; in the future it is negative."""
    return hour_of(now) - hour_of(ts)


def hour_slots(df: DataFrame, ts: str, now: Column, by: str, weight: Column | None = None, slots: int = SLOTS) -> DataFrame:
    """(by, counts, total, peak): rows of each of the last `slots` hours, the oldest first, the hour of now last.

    One aggregate with a counter a slot: what lies outside is filtered before it is grouped, so a stray date costs nothing. Tenants
    without a row in these hours give no row. weight: counts that are summed up already.
    """
    age = age_in_hours(F.col(ts).cast("timestamp"), now)
    recent = df.withColumn("__age", age).where(F.col("__age").between(0, slots - 1)).withColumn("__w", weight if weight is not None else F.lit(1))
    each = [F.coalesce(F.sum(F.when(F.col("__age") == slots - 1 - k, F.col("__w"))), F.lit(0)).cast("long").alias(f"__{k}") for k in range(slots)]
    counted = recent.groupBy(by).agg(*each)
    counts = F.array(*[f"__{k}" for k in range(slots)])
    return counted.select(by, counts.alias("counts"), sum((F.col(f"__{k}") for k in range(1, slots)), F.col("__0")).alias("total"), F.array_max(counts).alias("peak"))


def hourly_windows(stream: DataFrame, ts: str, by: str, delay: str = "2 hours") -> DataFrame:
    """(by, hour, n): counts by tenant and hour of a stream or a batch; a stream closes an hour `delay` behind its latest row."""
    marked = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    counted = marked.groupBy(by, F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("hour"), "n")
