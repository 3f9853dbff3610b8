"""Row numbers over whole results without one task that sees them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.plans.registry import scratch

LOCAL_BITS = 33  # monotonically_increasing_id() keeps the partition above these bits and the place in it below


def numbered_all(df: DataFrame, *order: str | Column, name: str = "ordinal", start: int = 1) -> DataFrame:
    """df with `name`, the row's place from `start` in the order of `order` over all rows.

    A range partition by the order puts partition after partition; each is sorted and written once with the place inside it.
    What goes through the driver is one count a partition, whose prefix sums are broadcast and added. Rows equal in `order` are
    put apart by a hash of their plain columns, so a value that most rows share is dealt out to many tasks too; name a total
    order where theirs matters. A column called `name` is replaced.
    """
    plain = [f.name for f in df.schema if f.name != name and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType))]
    keys = [*(F.col(c) if isinstance(c, str) else c for c in order), *([F.xxhash64(*plain)] if plain else [])]
    place = "__numbered"
    path = scratch(df.sparkSession, "numbered")
    rows = df.drop(name).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(place, F.monotonically_increasing_id())
    rows.write.parquet(path, compression="zstd")
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    part = F.shiftright(place, LOCAL_BITS).cast("int")
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())
    before = list(accumulate((n for _, n in sizes), initial=start))
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "__part int, __before long")
    numbered = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row a partition
    local = F.col(place).bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return numbered.withColumn(name, F.col("__before") + local).drop("__part", "__before", place)
