"""Live snapshots as a stream: every micro-batch is appended to what is stored and merged when it is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlore.operators.merge import log_identity

POLL_SECONDS, LEAST_SECONDS = 15, 3
COMPACT_EVERY = 32  # batches between two compactions
COMMITS = "number long, kind string"


def poll_interval(seconds: int | None) -> str:
    """Trigger interval: 15 seconds unless set, never under 3."""
    return f"{max(LEAST_SECONDS, seconds or POLL_SECONDS)} seconds"


class MergedTable:
    """A change log below one path, read through a merge: entities last-wins at their first place, logs first-wins.

    Batch n is the folder batch-n, written once and overwritten by a replay; a row in `commits` says that it is whole. Now
    and then the merged state is written as base-n, which stands for all batches up to n; what the base before it stood for is
    emptied then, as nothing reads it any more. All there is to know is in the files, so a new object on the same path goes on
    where the last one ended.

    fetched names a column that tells when a row's snapshot was fetched. It comes before the batch in the order of rows, so a
    snapshot that was fetched earlier and arrives later doesn't win over a newer one. Rows without that time count as oldest.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, logs: bool = False, compact_every: int = COMPACT_EVERY, fetched: str | None = None):
        self.spark, self.path, self.key, self.order, self.logs, self.compact_every, self.fetched = spark, path, key, order, logs, compact_every, fetched

    def commits(self) -> list[tuple[int, str]]:
        """The last base and the batches since; what came before stays in the files."""
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
            base = rows.where("kind = 'base'").agg(F.max("number")).first()[0]
        except AnalysisException:
            return []
        return sorted({(r["number"], r["kind"]) for r in rows.where(F.col("number") >= F.lit(-1 if base is None else base)).collect()})

    def _commit(self, number: int, kind: str) -> None:
        self.spark.createDataFrame([(number, kind)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _parts(self, commits: list[tuple[int, str]]) -> tuple[int | None, list[int]]:
        """The last base, and the batches after it."""
        base = max((n for n, kind in commits if kind == "base"), default=None)
        return base, [n for n, kind in commits if kind == "batch" and (base is None or n > base)]

    def read(self) -> DataFrame | None:
        """The merged rows with `position`, (fetched, batch, order) of the first appearance; nothing before the first batch."""
        state = self._state(*self._parts(self.commits()))
        return None if state is None else state.drop("__at")

    def _state(self, base: int | None, batches: list[int]) -> DataFrame | None:
        frames = [self.spark.read.parquet(f"{self.path}/base-{base}")] if base is not None else []
        for n in batches:
            rows = self.spark.read.parquet(f"{self.path}/batch-{n}")
            when = [F.col(self.fetched).cast("timestamp").alias("fetched")] if self.fetched else []
            at = F.struct(*when, F.lit(n).cast("long").alias("batch"), F.col(self.order).alias("ord"))
            frames.append(rows.withColumns({"position": at, "__at": at}))
        if not frames:
            return None
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f, allowMissingColumns=True)
        return self._merged(rows)

    def _merged(self, rows: DataFrame) -> DataFrame:
        content = [c for c in rows.columns if c not in ("position", "__at")]
        identity: Column = log_identity([c for c in content if c not in (self.order, self.fetched)], self.key) if self.logs else F.col(self.key)
        chosen, bound = (F.min_by, F.min) if self.logs else (F.max_by, F.max)
        kept = rows if self.logs else rows.where(F.col(self.key).isNotNull())
        merged = kept.groupBy(identity.alias("__identity")).agg(chosen(F.struct(*content), F.col("__at")).alias("__row"), F.min("position").alias("position"), bound("__at").alias("__at"))
        return merged.select("__row.*", "position", "__at")

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Append a micro-batch; one that is committed already is skipped."""
        commits = self.commits()
        if any(n >= number for n, _ in commits):
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        self._commit(number, "batch")
        if len(self._parts(commits)[1]) + 1 >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """Write the merged state as the new base; a reader that began before still finds what the last base stands beside."""
        base, batches = self._parts(self.commits())
        if not batches:
            return
        self._state(base, batches).write.mode("overwrite").parquet(f"{self.path}/base-{batches[-1]}")
        self._commit(batches[-1], "base")
        if base is not None:
            known = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
            bases = sorted(r["number"] for r in known.where("kind = 'base'").orderBy(F.desc("number")).limit(3).collect())
            older = bases[0] if len(bases) == 3 else -1  # what lies before it was emptied with it
            gone = [f"batch-{r['number']}" for r in known.where(f"kind = 'batch' AND number > {older} AND number <= {base}").collect()]
            for folder in [*gone, *([f"base-{older}"] if older >= 0 else [])]:
                self._empty(f"{self.path}/{folder}")

    def _empty(self, path: str) -> None:
        """Overwrite a folder by no rows: its data are gone, by Spark's own writer, on whatever store it lies."""
        schema = self.spark.read.parquet(path).schema
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def follow(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None, once: bool = False) -> StreamingQuery:
    """Start a query that hands each micro-batch to sink; one query runs one batch at a time, so refreshes never overlap."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll_interval(seconds))).start()


def distinct_within(stream: DataFrame, key: str, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """An extension: drops repeats of a key that arrive within the delay; which of them stays depends on arrival."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
