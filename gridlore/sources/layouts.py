"""Stored layouts that let a scan skip: payloads as shredded variants, records clustered with bloom filters, files with a
trigram index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.operators.search import joined_text, text_search

# ---- payloads


@contextmanager
def session_settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of a write; __ stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store_payloads(records: DataFrame, path: str, payload: str = "payload") -> None:
    """Records with their payload text as a variant, shredded: the fields that payloads share are Parquet columns of their own.

    The text is parsed once, here. A text that isn't JSON has a null payload and stays as `malformed`.
    """
    parsed = F.try_parse_json(payload)
    rows = records.withColumns({payload: parsed, "malformed": F.when(F.col(payload).isNotNull() & parsed.isNull(), F.col(payload))})
    with session_settings(records.sparkSession, spark__sql__variant__writeShredding__enabled="true", spark__sql__variant__inferShreddingSchema="true"):
        rows.write.mode("overwrite").parquet(path)


def payload_fields(stored: DataFrame, fields: dict[str, str], payload: str = "payload") -> DataFrame:
    """The stored columns with fields {name: type} of the payload instead of it; a scan reads these fields alone. A field that is
    missing or of another type is null."""
    others = [c for c in stored.columns if c != payload]
    return stored.select(*others, *[F.try_variant_get(payload, f"$.{n}", t).alias(n) for n, t in fields.items()])


# ---- point reads


def store_clustered(records: DataFrame, path: str, tenant: str, key: str, files: int | None = None, row_group_bytes: int | None = None, ids: int = 1_000_000) -> None:
    """Records by ranges of tenant and key, sorted inside, with a bloom filter of the key a row group.

    A tenant is in few files, and inside these footers' ranges leave few row groups; a key alone is found by the filters.
    """
    by = (files, tenant, key) if files else (tenant, key)
    writer = records.repartitionByRange(*by).sortWithinPartitions(tenant, key).write.mode("overwrite")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(ids))
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(min(row_group_bytes, 1 << 20)))
    writer.parquet(path)


# ---- substring search

TRIGRAM_BITS = 18  # 2^18 bits, 32 kB, for a file's trigrams; more of a file's bits are set the larger it is


def trigrams(text: Column) -> Column:
    """Hashes of all three characters in a row of a text; shorter texts have none."""
    chars = F.split(text, "")
    one = lambda c: F.when(
        F.size(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(2), F.size(c) - 1), lambda i: F.pmod(F.xxhash64(F.get(c, i - 2), F.get(c, i - 1), F.get(c, i)), F.lit(1 << TRIGRAM_BITS))))
    )
    return F.get(F.transform(F.array(chars), one), F.lit(0))


def trigram_index(stored: DataFrame, scalars: Iterable[str], arrays: Iterable[str] = ()) -> DataFrame:
    """(file, word, bits): which trigrams the searched text of each file's rows has, 64 a word, set before the shuffle.

    Bits are joined by OR in a hash table of 4,096 words a file, so a task's memory doesn't grow with its texts; a bitmap
    aggregate would sort all of their trigrams.
    """
    opened = stored.select(F.col("_metadata.file_path").alias("file"), F.explode(trigrams(joined_text(scalars, arrays))).alias("__h"))
    return opened.groupBy("file", _word("__h").alias("word")).agg(F.bit_or(_bit("__h")).alias("bits"))


def _word(number: str) -> Column:
    return F.shiftright(number, 6).cast("int")


def _bit(number: str) -> Column:
    """The number's bit in its word."""
    return F.expr(f"shiftleft(1L, CAST({number} & 63 AS INT))")


def files_without_index(stored: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of the files that an index doesn't know yet, after others were appended; index these and append the result to it."""
    known = index.select("file").distinct()
    new = stored.select(F.col("_metadata.file_path").alias("file")).distinct().join(known, "file", "left_anti")
    names = sorted(unquote(r["file"]) for r in new.collect())  # names of new files
    return stored.sparkSession.read.schema(stored.schema).parquet(*names) if names else stored.where(F.lit(False))


def files_with(index: DataFrame, query: str) -> list[str] | None:
    """Files that may have the query: those with all of its trigrams. None where it is too short to tell."""
    wanted = query.strip().lower()
    if len(wanted) < 3:
        return None
    spark = index.sparkSession
    asked = spark.createDataFrame([(wanted,)], "q string").select(F.explode(trigrams(F.col("q"))).alias("h"))
    asked = asked.groupBy(_word("h").alias("word")).agg(F.bit_or(_bit("h")).alias("wanted"))
    number = asked.count()
    there = F.col("bits").bitwiseAND(F.col("wanted")) == F.col("wanted")
    hits = index.join(F.broadcast(asked), "word").where(there).groupBy("file").agg(F.count_distinct("word").alias("n")).where(F.col("n") == number)
    return sorted(unquote(r["file"]) for r in hits.select("file").collect())  # names of files, as a listing has them


def indexed_search(stored: DataFrame, index: DataFrame, query: str, scalars: Iterable[str], arrays: Iterable[str] = ()) -> tuple[DataFrame, int | None]:
    """(rows of stored that text_search finds, files read): the index leaves files out, the substring test stays exact.

    A query of fewer than three characters reads all files (None).
    """
    files = files_with(index, query)
    if files is None:
        return text_search(stored, query, scalars, arrays), None
    rows = stored.sparkSession.read.schema(stored.schema).parquet(*files) if files else stored.where(F.lit(False))
    return text_search(rows, query, scalars, arrays), len(files)
