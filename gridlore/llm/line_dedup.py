"""Line dedup over levelled sorted runs of line hashes.

A run holds (h1, h2, doc), a line key's hash and a document that has it, bucketed and sorted by all three. Each batch of
documents merge-anti-joins the live runs, bucket by bucket and without shuffling them, and adds the pairs that are new as a run of level 0; a
level of `fanout` runs is compacted into one run of the next level. So a pair stands in the runs once, whatever the order
of batches and however often a document comes, and one aggregation of the runs gives each key's documents and holder. All of
it is DataFrame code: no Python runs on executors.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import WHITE, ascii_lower, let, read, shared_path, staged

MIN_CHARS, MIN_DOCS = 40, 5
N_BATCHES, FANOUT = 4, 2
HOT_KEYS = 4096  # keys held by over 1/HOT_KEYS of all (document, key) pairs: so many at most, broadcast
NO_ID = -(2**63)
KEYS = "h1, h2, doc"
RUN = "h1 long, h2 long, doc long"
MANIFEST = "version long, level int, run long, buckets int"


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def key_hash(key: Column) -> Column:
    """128 bits in two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs below one path of the shared folder.

    Each change writes the list of the live runs as the next version of a manifest, so that a later batch, in another
    session too, goes on from the path alone. Runs are external tables for as long as the object is open: only so does Spark know
    of their buckets.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.path = spark, fanout, path or shared_path(spark, "line-runs")
        self.levels: list[list[tuple[int, str]]] = []  # (run, table)
        self.written = self.version = 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if path:
            try:
                manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
                self.version = manifest.agg(F.max("version")).first()[0] or 0
                told = manifest.where(F.col("version") == self.version).collect()  # a row a live run
            except AnalysisException:
                told = []
            for r in sorted(told, key=lambda r: r["run"]):
                self.buckets = r["buckets"]
                name = self._name()
                spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY ({KEYS}) SORTED BY ({KEYS}) INTO {self.buckets} BUCKETS LOCATION '{self._folder(r['level'], r['run'])}'")
                self._place(r["level"], r["run"], name)
                self.written = max(self.written, r["run"] + 1)

    def _name(self) -> str:
        return f"line_run_{uuid.uuid4().hex}"

    def _folder(self, level: int, run: int) -> str:
        return f"{self.path}/level={level}/run={run}"

    def _place(self, level: int, run: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, name))

    def save(self) -> None:
        self.version += 1
        rows = [(self.version, level, run, self.buckets) for level, runs in enumerate(self.levels) for run, _ in runs]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, pairs: DataFrame, level: int) -> None:
        """Rows come dealt out by all three columns, so a bucket is one sorted file. A half-written folder of a lost session is overwritten."""
        keys, name = KEYS.split(", "), self._name()
        pairs.select(*keys).write.bucketBy(self.buckets, *keys).sortBy(*keys).mode("overwrite").option("path", self._folder(level, self.written)).format("parquet").saveAsTable(name)
        self._place(level, self.written, name)
        self.written += 1

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for _, name in level]

    def add(self, pairs: DataFrame) -> None:
        """Add a run and compact every level that became full."""
        self._write(pairs, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            both = reduce(DataFrame.unionByName, [self.spark.table(name) for _, name in full])
            self._write(both.repartition(self.buckets, *KEYS.split(", ")), level + 1)
            self._drop(full)
            level += 1

    def fresh(self, lines: DataFrame) -> DataFrame:
        """The pairs of a batch (doc, h1, h2) that no run has."""
        keys = KEYS.split(", ")
        pairs = lines.select(*keys).distinct()
        for run in self.tables():
            pairs = pairs.join(run.hint("merge"), keys, "left_anti")
        return pairs

    def ingest(self, lines: DataFrame) -> None:
        self.add(self.fresh(lines))
        self.save()

    def keys(self) -> DataFrame:
        """(h1, h2, n_docs, holder) of every key; a hot key is counted on the map side."""
        tables = self.tables()
        pairs = reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], RUN)
        return pairs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("holder"))

    def _drop(self, runs: list[tuple[int, str]]) -> None:
        for _, name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name alone: files of external tables stay

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)


def dropped_keys(lines: DataFrame, min_docs: int, n_batches: int, fanout: int, path: str | None = None) -> DataFrame:
    """(doc, row, drops): the places of the lines each text loses; texts that lose nothing have no row."""
    runs = LineRuns(lines.sparkSession, path, fanout)
    try:
        for k in range(n_batches):
            runs.ingest(lines if n_batches == 1 else lines.where(F.pmod(F.xxhash64("doc"), F.lit(n_batches)) == k))
        settled = staged(runs.keys().where(F.col("n_docs") >= min_docs), "line-keys")
    finally:  # a metastore outlives the session
        runs.close()
    hot = staged(settled.where(F.col("n_docs") * HOT_KEYS > lines.count()).select("h1", "h2", "holder"), "line-hot")
    if path:  # keys of all earlier batches count as documents, so more than HOT_KEYS may pass
        hot = staged(hot.join(lines.select("h1", "h2"), ["h1", "h2"], "left_semi").orderBy("h1", "h2").limit(HOT_KEYS), "line-hot")
    cold = settled.select("h1", "h2", "holder").join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    of_hot = lines.join(F.broadcast(hot), ["h1", "h2"]).select("doc", "row", "pos", "holder")
    rest = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    of_cold = rest.join(cold.hint("merge"), ["h1", "h2"]).select("doc", "row", "pos", "holder")
    lost = of_hot.unionByName(of_cold).where(F.col("doc") < F.col("holder"))
    return lost.groupBy("doc", "row").agg(F.collect_set("pos").alias("drops"))  # a set: repeated rows say the same


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_batches: int = N_BATCHES, fanout: int = FANOUT, path: str | None = None) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped added.

    Keys of at least min_chars code points found in at least min_docs documents lose all their lines except in the
    largest doc_id holding them. A null text is one empty line. Rows of equal doc_id are one document; null ids are one
    document below all others. Clashing input columns keep their values: the three added names are replaced only.

    path: runs that earlier calls left there count too, and this call's are added. Ids may come in any order, documents again.
    The texts of earlier calls aren't changed by a later one that brings their key's fifth document or a larger id.
    """
    doc, row = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))

    def hashed(line: Column) -> Column:
        return let(line_key(line), lambda k: F.when(F.char_length(k) >= min_chars, key_hash(k)))

    opened = docs.select(doc.alias("doc"), row.alias("row"), F.posexplode(F.transform(lines_of(F.col(text)), hashed)).alias("pos", "h")).where("h is not null")
    lines = staged(opened.select("doc", "row", "pos", "h.h1", "h.h2"), "line-hashes")
    drops = dropped_keys(lines, min_docs, n_batches, fanout, path).withColumnsRenamed({"doc": "__doc", "row": "__row", "drops": "__drops"})
    joined = docs.join(drops, (doc == F.col("__doc")) & (row == F.col("__row")), "left")
    body = lines_of(F.col(text))

    def without(lines: Column, gone: Column) -> Column:
        """array_except hashes the places, so a text of many lines and many losses takes linear time."""
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda p: F.get(lines, p))

    kept = F.when(F.col("__drops").isNull(), body).otherwise(let(body, lambda x: without(x, F.col("__drops"))))
    return (
        joined.withColumn("__kept", kept)
        .withColumns({"n_lines": F.size(body).cast("long"), "n_dropped": (F.size(body) - F.size("__kept")).cast("long"), "kept_text": F.array_join("__kept", "\n")})
        .drop("__doc", "__row", "__drops", "__kept")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM l
), q AS (
  SELECT line_key, max(doc_id) AS holder FROM k WHERE length(line_key) >= 40
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id < q.holder, false) AS gone
  FROM k LEFT JOIN q ON k.line_key = q.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
