"""Logs without their copies, across micro-batches and restarts: of the copies of a key the one of the lowest ordinal stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlore.sources.layouts import session_settings
from gridlore.streaming.live import follow

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_by_key(stream: DataFrame, key: str, order: str, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """The stream with one row a key, that of the lowest ordinal among copies that follow each other within `delay` in event time.

    A key's copies are a session window, so the state is one row a key and no code runs for each key. A row is given out when the
    watermark is `delay` behind the last of its copies, so a better copy that comes in a later micro-batch, or after a restart,
    still wins. The state holds the keys of that time and no more. Rows without a key or a time are no logs and stay out; a row
    without an ordinal comes after those that have one; later copies than the watermark start anew or are dropped.
    """
    marked = stream.where(F.col(key).isNotNull()).withWatermark(event_time, delay)
    place = F.struct(F.col(order).isNull(), F.col(order), F.col(event_time))
    sessions = marked.groupBy(F.col(key).alias("__key"), F.session_window(event_time, delay).alias("__session"))
    return sessions.agg(F.min_by(F.struct(*stream.columns), place).alias("__row")).select("__row.*")


def follow_first(spark: SparkSession, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """follow() with a state store that doesn't keep all keys in memory; only this query gets it."""
    with session_settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):
        return follow(stream, sink, checkpoint, once=once)
