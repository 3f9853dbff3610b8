"""Merging of snapshots, and changes kept as an append-only log read through latest-wins views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.text import absent_to

COPIES = 1000  # equal changes that are numbered together
DEALT = 64  # partitions at least that they are dealt to: what follows groups them there, row by row


def stacked(older: DataFrame, newer: DataFrame, order: str) -> DataFrame:
    """Both frames with their source (0, 1); columns that one lacks are null."""
    return older.withColumn("__source", F.lit(0)).unionByName(newer.withColumn("__source", F.lit(1)), allowMissingColumns=True).withColumn("__at", F.struct("__source", F.col(order)))


def merge_entities(stored: DataFrame, live: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """One row a key, the last one's whole content at the first one's place; rows without a key go.

    `position` is (source, order) of the first appearance; sorting by it gives the order of first appearances. A key
    with most of the rows is combined before it is shuffled.
    """
    both = stacked(stored, live, order).where(F.col(key).isNotNull())
    whole = F.struct(*[c for c in both.columns if c not in ("__source", "__at")])
    return both.groupBy(F.col(key).alias("__key")).agg(F.max_by(whole, "__at").alias("__row"), F.min("__at").alias("position")).select("__row.*", "position")


def log_identity(columns: list[str], key: str) -> Column:
    """A log row's key, or its content as JSON where it has none."""
    return F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("j"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def merge_logs(stored: DataFrame, live: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """One row a key, the first one; rows without a key are kept apart by their content as JSON."""
    content = [c for c in dict.fromkeys([*stored.columns, *live.columns]) if c != order]
    both = stacked(stored, live, order)
    whole = F.struct(*[c for c in both.columns if c not in ("__source", "__at")])
    first = both.groupBy(log_identity(content, key).alias("__identity")).agg(F.min_by(whole, "__at").alias("__row"), F.min("__at").alias("position"))
    return first.select("__row.*", "position")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State of a change log: the last row of each key; rows without a key are inserts and all stay.

    max_by over a struct aggregates on the map side, so a key with most of the log costs one row a task.
    """
    whole = F.struct(*log.columns)
    absent = F.lit(False)
    for k in keys:
        absent = absent | F.col(k).isNull() | (F.col(k).cast("string") == "")
    state = log.where(~absent).groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("__row")).select("__row.*")
    return state.unionByName(log.where(absent))


def upsert(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with changes appended; writing them is df.write.mode('append')."""
    return log.unionByName(changes, allowMissingColumns=True)


def applied_state(records: DataFrame, flags: DataFrame, key: str = "id", flag_key: str = "record_id", at: str = "at") -> DataFrame:
    """Records with the last flag set on them: applied and applied_at (null unless applied)."""
    last = latest(flags, [flag_key], [at, "applied"]).select(F.col(flag_key).alias("__key"), F.col("applied"), F.col(at).alias("__at"))
    out = records.join(last, F.col(key) == F.col("__key"), "left").drop("__key").withColumn("applied", F.coalesce("applied", F.lit(False)))
    return out.withColumn("applied_at", F.when(F.col("applied"), F.col("__at"))).drop("__at")


def mitigation_status(applied: Column, payload_status: Column) -> Column:
    """Applied means implemented; else the payload's own status, else proposed."""
    return F.when(F.coalesce(applied, F.lit(False)), "implemented").otherwise(absent_to(payload_status, F.lit("proposed")))


def record_id(site: Column, external: Column) -> Column:
    """128 bits of a digest of tenant and external id: among 10^18 records two share an id with probability 10^-3."""
    return F.substring(F.sha2(F.to_json(F.struct(site.cast("string").alias("s"), external.cast("string").alias("e"))), 256), 1, 32)


def ingested(log: DataFrame, changes: DataFrame, site: str = "site_id", external: str = "external_id", at: str = "at") -> tuple[DataFrame, DataFrame]:
    """(log with the changes appended, answers (ok, persistedRecordId)): one answer a change.

    A record's id follows from its tenant and external id, so the same record is answered with the same id each time. A
    change without an external id is a record of its own, equal ones of one moment too: they are counted before they are
    numbered, so a replay gives the same ids. Flags set on a record are a log of their own and stay.
    """
    named = F.nullif(F.col(external).cast("string"), F.lit(""))
    known = changes.where(named.isNotNull()).withColumn("id", record_id(F.col(site), F.concat(F.lit("k"), named)))
    copies = _numbered_copies(changes.where(named.isNull()))
    own = F.to_json(F.struct(*changes.columns, "__copy"), {"ignoreNullFields": "false"})
    rows = known.unionByName(copies.withColumn("id", record_id(F.col(site), F.concat(F.lit("c"), own))).drop("__copy"))
    return upsert(log, rows), rows.select(F.lit(True).alias("ok"), F.col("id").alias("persistedRecordId"))


def _numbered_copies(changes: DataFrame) -> DataFrame:
    """Each change with `__copy`, its number from 1 among equal ones.

    Numbers are made in runs of COPIES that are dealt out first, so a change that most rows equal isn't one task's. The number
    of partitions is given, as the runs are too small for Spark to tell what they become.
    """
    counted = changes.groupBy(*changes.columns).agg(F.count("*").alias("__n"))
    runs = counted.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), "__n", F.lit(COPIES).cast("long"))))
    dealt = runs.repartition(max(DEALT, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *changes.columns, "__from")
    return dealt.withColumn("__copy", F.explode(F.sequence("__from", F.least(F.col("__from") + (COPIES - 1), "__n")))).drop("__n", "__from")


def prefer(live: Column, stored: Column) -> Column:
    return F.coalesce(live, stored)
