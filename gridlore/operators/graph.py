"""Layers, node positions and edge flags of the network diagram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.functions.text import zone_layer
from gridlore.operators.joins import small

LAYERS = ("L0", "L1", "L2", "L3", "L4", "DMZ")
X_STEP, Y_STEP = 250, 200


def layer_number(layer: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LAYERS]), layer)


def positions(assets: DataFrame, layer: str, order: list[str], base: Column | None = None) -> DataFrame:
    """x by layer, y by place inside the layer."""
    place = F.row_number().over(Window.partitionBy(layer).orderBy(*order)) - 1
    return assets.withColumns({"place": place, "x": layer_number(F.col(layer)) * X_STEP}).withColumn("y", (base if base is not None else F.lit(0)) + F.col("place") * Y_STEP)


def assets_per_layer(assets: DataFrame, zone: str = "zone") -> DataFrame:
    """Number of assets of each of the six layers, 0 included."""
    counts = assets.groupBy(zone_layer(F.col(zone)).alias("layer")).agg(F.count("*").alias("n"))
    every = assets.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    return every.join(counts, "layer", "left").select("layer", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def edges(connections: DataFrame, assets: DataFrame, order: str | None = None) -> DataFrame:
    """Connections with the layers of both ends and their flags; an unknown asset lies in L2 and its edge stays.

    A repeated asset id counts with its first row in the given order, else with its smallest zone.
    """
    zone = F.min_by("zone", order) if order else F.min("zone")
    ends = small(assets.groupBy("asset_id").agg(zone.alias("zone")))
    out = connections
    for side, key in (("source", "source_asset_id"), ("target", "destination_asset_id")):
        end = ends.select(F.col("asset_id").alias("__id"), F.col("zone").alias("__zone"))
        out = out.join(end, F.col(key) == F.col("__id"), "left").withColumn(f"{side}_layer", zone_layer(F.col("__zone"))).drop("__id", "__zone")
    return out.withColumns(edge_flags(F.col("source_layer"), F.col("target_layer"), F.col("reliability"), F.col("security_level")))


def edge_flags(source: Column, target: Column, reliability: Column, security: Column) -> dict[str, Column]:
    """Only the exact word None is unsecured."""
    critical, unsecured = F.coalesce(reliability == "Critical", F.lit(False)), F.coalesce(security == "None", F.lit(False))
    return {"cross_layer": source != target, "critical": critical, "unsecured": unsecured, "width": F.when(critical, 4).otherwise(2), "dash": F.when(unsecured, "5,5").otherwise("none")}
