"""Readers of tables, snapshots and registers; all of them lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions.text import absent_to
from gridlore.operators.merge import mitigation_status
from gridlore.operators.search import tenant_scan
from gridlore.sources import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Snapshot:
    """The four lists of an incident snapshot, its statistics, and when it was fetched."""

    chains: DataFrame
    alerts: DataFrame
    logs: DataFrame
    mitigations: DataFrame
    stats: DataFrame | None = None
    fetched_at: Column | None = None


PARTS = {"chains": schemas.CHAINS, "alerts": schemas.ALERTS, "logs": schemas.LOGS, "mitigations": schemas.MITIGATIONS}


def fetched_at(json: str = "value") -> Column:
    """When a snapshot was fetched, as it says itself; null if it doesn't."""
    return F.try_to_timestamp(F.coalesce(F.get_json_object(json, "$.fetchedAt"), F.get_json_object(json, "$.fetched_at")))


def snapshot_part(whole: DataFrame, name: str, fetched: str | None = None, offset: str | None = None) -> DataFrame:
    """Rows of one list of snapshots, from a column `value` of JSON objects, batch or stream; fetched: the name of a column for when.

    `ord` is the place in the list. A list too long for one object comes in pages, each a snapshot of its own; offset names the
    field that tells the place of a page's first row (0 without it). What a snapshot says once is read once, not again for each row.
    """
    when = [fetched_at().alias(fetched)] if fetched else []
    begins = F.coalesce(F.get_json_object("value", f"$.{offset}").try_cast("long"), F.lit(0).cast("long")) if offset else F.lit(0).cast("long")
    lists = whole.select(*when, begins.alias("__begins"), _list("value", name, PARTS[name]).alias("__list"))
    rows = lists.select(*([fetched] if fetched else []), "__begins", F.posexplode("__list").alias("ord", "row")).where("row is not null")
    return rows.select("row.*", (F.col("__begins") + F.col("ord")).alias("ord"), *([F.col(fetched)] if fetched else []))


def snapshot_stream(spark: SparkSession, path: str, name: str, files_per_batch: int | None = 1, fetched: str | None = None, offset: str | None = None, lines: bool = False) -> DataFrame:
    """One list of the snapshots dropped into a folder, as a stream: a file is a snapshot (lines: a line is one), a micro-batch takes
    the next files, all that are there if files_per_batch is None."""
    source = spark.readStream.format("text").option("wholetext", not lines)
    if files_per_batch is not None:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return snapshot_part(source.load(path), name, fetched, offset)


def fixture(spark: SparkSession, parts: dict[str, list[tuple]], stats: list[tuple] | None = None) -> Snapshot:
    """A snapshot of given rows (a demo): parts that aren't named are empty; `ord` is the place in the list."""
    from pyspark.sql.types import LongType, StructField, StructType

    def part(name: str) -> DataFrame:
        schema = StructType.fromDDL(PARTS[name])
        return spark.createDataFrame([(*r, k) for k, r in enumerate(parts.get(name, []))], StructType([*schema.fields, StructField("ord", LongType())]))

    return Snapshot(*[part(n) for n in PARTS], stats=spark.createDataFrame(stats, schemas.STATS) if stats else None, fetched_at=F.current_timestamp())


def snapshot_json(spark: SparkSession, path: str) -> Snapshot:
    """Snapshots from files of one JSON object each; a part that isn't a list is empty, unknown fields are left out.

    `ord` is the place in the list, on which first- and last-wins rules rest.
    """
    whole = spark.read.text(path, wholetext=True)
    stats = whole.select(F.from_json(F.get_json_object("value", "$.stats"), schemas.STATS).alias("s")).where("s is not null").select("s.*")
    return Snapshot(*[snapshot_part(whole, n) for n in PARTS], stats=stats, fetched_at=F.coalesce(fetched_at(), F.current_timestamp()))


def _list(json: str, name: str, ddl: str) -> Column:
    """A list of objects; what isn't a list is null (from_json alone would make one of a single object)."""
    part = F.get_json_object(json, f"$.{name}")
    return F.when(part.startswith("["), F.from_json(part, f"array<struct<{_fields(ddl)}>>"))


def _fields(ddl: str) -> str:
    """`a string, b array<...>` as the inside of a struct type."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def register_sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of register files (one JSON object each)."""
    return sheets_of(spark.read.text(path, wholetext=True))


def sheets_of(whole: DataFrame) -> dict[str, DataFrame]:
    """The sheets of registers in a column `value` of JSON objects, and `metadata` as a map column; malformed ones have no rows."""
    sheets = {
        name: whole.select(F.explode(_list("value", name, ddl)).alias("row")).where("row is not null").select("row.*")
        for name, ddl in schemas.REGISTER.items()
    }
    return sheets | {"metadata": whole.select(F.from_json(F.get_json_object("value", "$.metadata"), "map<string,string>").alias("metadata"))}


def payload_id(payload: Column, external_id: Column) -> Column:
    """The payload's own id, or the record's external one where it has none."""
    return absent_to(F.try_variant_get(payload, "$.id", "string"), external_id)


def flatten_payload(records: DataFrame, ddl: str) -> DataFrame:
    """Records as typed rows: the payload's fields, id, and the record's own id as persistedRecordId.

    The payload is JSON text, parsed once a row, or a stored variant (layouts.store_payloads), of which a scan reads the fields
    of the schema alone. A field of another type than the schema's is null; a payload that isn't JSON has no fields.
    """
    from pyspark.sql.types import StructType

    kept = [c for c in ("applied", "applied_at") if c in records.columns]
    stored = records.schema["payload"].dataType.typeName() == "variant"
    body = F.col("payload") if stored else F.try_parse_json("payload")
    out = records.select(F.col("id").alias("persistedRecordId"), "external_id", *kept, body.alias("__body"))
    fields = [F.try_variant_get("__body", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in StructType.fromDDL(ddl) if f.name != "id"]
    out = out.select(payload_id(F.col("__body"), F.col("external_id")).alias("id"), "persistedRecordId", *kept, *fields)
    if "applied" in kept:
        out = out.withColumn("status", mitigation_status(F.col("applied"), F.col("status")))
    return out


def persisted_snapshot(chains: DataFrame, alerts: DataFrame, mitigations: DataFrame, site_id: int) -> Snapshot:
    """A tenant's stored records as a snapshot: no logs, no statistics, fetched now."""
    spark = chains.sparkSession
    logs = spark.createDataFrame([], schemas.LOGS)
    parts = [flatten_payload(tenant_scan(df, site_id), ddl) for df, ddl in ((chains, schemas.CHAINS), (alerts, schemas.ALERTS), (mitigations, schemas.MITIGATIONS))]
    return Snapshot(parts[0], parts[1], logs, parts[2], None, F.current_timestamp())


def seed(sites: DataFrame, rows: DataFrame, key: str = "username") -> DataFrame:
    """Sites with the seed rows whose key no site has yet."""
    return sites.unionByName(rows.join(sites.select(key), key, "left_anti"), allowMissingColumns=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, partition_by: str = "site_id") -> None:
    """Changes appended to a tenant-partitioned log."""
    df.write.mode("append").partitionBy(partition_by).parquet(path)
