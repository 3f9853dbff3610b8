"""Register sheets as tables: columns, metadata rows, sheet choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHEETS = ("assets", "network_interfaces", "network_ranges", "connections", "software", "security_zones", "protocols_used")
OVERVIEW = "overview"


def column_keys(df: DataFrame, json: str, alias: str = "key") -> DataFrame:
    """All keys that occur in a column of JSON objects, once each; rows that aren't objects have none."""
    return df.select(F.explode(F.json_object_keys(F.col(json))).alias(alias)).distinct()


def locale_order(key: str) -> Column:
    """Alphabetical whatever the case, as a locale sorts; binary order breaks ties."""
    return F.collate(F.col(key), "UNICODE")


def metadata_rows(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """(ids..., field, value): one row a field, values as text."""
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(ids, fields, "field", "value")


def sheet(frames: dict[str, DataFrame], name: str) -> DataFrame | None:
    """The sheet of that name; unknown names and the overview have no rows of their own."""
    return frames.get(name) if name != OVERVIEW else None


def numbered(df: DataFrame, order: list[str], group: str) -> DataFrame:
    """Row numbers from 1 inside each group."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("row_number", F.row_number().over(window))


def steps(chains: DataFrame, key: str = "id", column: str = "steps") -> DataFrame:
    """(key, number, step): steps in stored order, numbered from 1."""
    return chains.select(key, F.posexplode(column).alias("__pos", "step")).select(key, (F.col("__pos") + 1).alias("number"), "step")
