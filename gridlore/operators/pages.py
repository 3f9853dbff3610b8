"""Children of a parent as pages, so that no list grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.operators.ordinals import numbered_all

PAGE = 1000


def paged(children: DataFrame, parent: str, order: list[str], value: str, size: int = PAGE, name: str = "children") -> DataFrame:
    """(parent, page, children): page p, from 0, has the children p * size to p * size + size - 1 of the parent in their order.

    Rows are numbered over all parents by ranges, so the children of a hot parent lie in many of them; a parent's first number
    is taken off, and rows are grouped by parent and page, never by parent alone. Null parents have no pages.
    """
    rows = numbered_all(children.where(F.col(parent).isNotNull()).select(*dict.fromkeys([parent, *order, value])), parent, *order, name="__place", start=0)
    first = rows.groupBy(F.col(parent).alias("__parent")).agg(F.min("__place").alias("__first"))
    placed = rows.join(first, F.col(parent) == F.col("__parent")).withColumn("__at", F.col("__place") - F.col("__first"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(value).alias("__v")))), lambda x: x["__v"])
    return placed.groupBy(parent, F.floor(F.col("__at") / size).alias("page")).agg(lists.alias(name))


def page_of(pages: DataFrame, parents: DataFrame, key: str, parent: str, page: int = 0, name: str = "children") -> DataFrame:
    """Parents with one page of their children; none there: empty."""
    wanted = pages.where(F.col("page") == page).select(F.col(parent).alias("__key"), name)
    out = parents.join(wanted, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
