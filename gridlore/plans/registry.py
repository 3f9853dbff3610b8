"""The dictionaries of registered queries, and a folder for what a query writes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share; only where the session names none (local tests), a temporary one."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or tempfile.mkdtemp(prefix="gridlore-")
    return f"{shared.rstrip('/')}/gridlore/{context.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
