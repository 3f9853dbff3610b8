"""Registered queries over layouts and structures that keep work small: numbered results, shredded payloads, clustered records,
indexed search, stored bitmaps, sketches, pages, hour slots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.operators import assistant, bitmaps, heavy, ordinals, pages, search, slots
from gridlore.plans.registry import registered, scratch
from gridlore.sources import layouts
from gridlore.sources.readers import table
from gridlore.streaming import first_seen, live

_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> DataFrame:
    """A layout of a table, written by the first query of a session that reads it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch(spark, name)
        write(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


# ---- places in a whole result


@registered("SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS place FROM events")
def events_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its place in time."""
    return ordinals.numbered_all(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", name="place")


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM lineitem")
def lines_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most rows share their date with many others; the rest of the order tells them apart."""
    order = (F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_suppkey", "l_extendedprice")
    return ordinals.numbered_all(rows, *order, name="place", start=0).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "place")


# ---- payloads as variants


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mitigation records: a payload of several kinds of fields, some missing, some of another type, some no JSON."""

    def write(path: str) -> None:
        rows = table(spark, sf_dir, "orders")
        k = F.col("o_orderkey")
        body = F.to_json(
            F.struct(
                F.when(k % 3 != 0, F.concat(F.lit("m"), k)).alias("id"), F.col("o_orderpriority").alias("title"), F.when(k % 4 != 0, F.when(k % 8 == 1, "").otherwise("approved")).alias("status"),
                F.col("o_totalprice").alias("cost"), F.array(F.col("o_orderstatus"), F.lit("x")).alias("appliesToZones"), F.struct(F.col("o_custkey").alias("asset")).alias("layer"),
            )
        )
        text = F.when(k % 11 == 0, F.lit("{cut off")).when(k % 13 == 0, F.lit('{"title": 7, "status": ["x"]}')).otherwise(body)
        records = rows.select(k.alias("id"), F.col("o_custkey").alias("site_id"), F.concat(F.lit("ext-"), k).alias("external_id"), text.alias("payload"))
        layouts.store_payloads(records, path)

    return stored(spark, sf_dir, "payloads", write)


@registered("""
SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 3 = 0 THEN 'ext-' || o_orderkey ELSE 'm' || o_orderkey END AS id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '7' ELSE o_orderpriority END AS title FROM orders""")
def payload_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of each payload: the id, else the external one, and the title."""
    rows = layouts.payload_fields(_payloads(spark, sf_dir).withColumnRenamed("id", "record_id"), {"id": "string", "title": "string"})
    return rows.select("record_id", F.coalesce("id", "external_id").alias("id"), "title")


@registered("""
SELECT CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 8 = 1 THEN 'proposed' ELSE 'approved' END AS status, count(*) AS n
FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 <> 0 GROUP BY 1""")
def payload_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads by status, whose field is all that is read; a status that is a list is no status and stays out."""
    rows = layouts.payload_fields(_payloads(spark, sf_dir).select("payload"), {"status": "string"})
    return rows.where("status IS NULL OR NOT startswith(status, '[')").groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("proposed")).alias("status")).agg(F.count("*").alias("n"))


@registered("""
SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 11 = 0 THEN '{cut off' END AS malformed,
       CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS cost, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus || '/x' END AS zones,
       CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS asset FROM orders""")
def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole payloads back as JSON text, which is parsed anew: what was stored comes back, and texts that are no JSON as they were."""
    rows = _payloads(spark, sf_dir).select(F.col("id").alias("record_id"), "malformed", F.from_json(F.to_json("payload"), "cost double, appliesToZones array<string>, layer struct<asset: long>").alias("p"))
    return rows.select("record_id", "malformed", "p.cost", F.array_join("p.appliesToZones", "/").alias("zones"), F.col("p.layer.asset").alias("asset"))


# ---- point reads


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "clustered", lambda path: layouts.store_clustered(table(spark, sf_dir, "lineitem"), path, "l_suppkey", "l_orderkey"))


@registered("""
SELECT 'tenant and id' AS probe, l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 7 AND l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_suppkey = 7)
UNION ALL SELECT 'other tenant', l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = -7 AND l_orderkey = 3
UNION ALL SELECT 'tenant', l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 3
UNION ALL SELECT 'id', l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 101""")
def clustered_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a tenant, one of them, and one of any tenant by its id, from files clustered by tenant."""
    rows = _clustered(spark, sf_dir).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    mine = search.tenant(rows, 7, "l_suppkey")
    first = mine.agg(F.min("l_orderkey")).first()[0]
    probes = {"tenant and id": mine.where(F.col("l_orderkey") == first), "other tenant": search.tenant(rows, -7, "l_suppkey").where("l_orderkey = 3"), "tenant": search.tenant(rows, 3, "l_suppkey"), "id": rows.where("l_orderkey = 101")}
    out = [df.select(F.lit(name).alias("probe"), *rows.columns) for name, df in probes.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# ---- search


SEARCHED = ("doc_id", "lang", "source", "text")


def _searchable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def write(path: str) -> None:
        table(spark, sf_dir, "documents").select(*SEARCHED).repartitionByRange("source", "doc_id").write.mode("overwrite").parquet(path)

    rows = stored(spark, sf_dir, "searchable", write)
    return rows, stored(spark, sf_dir, "trigrams", lambda path: layouts.trigram_index(rows, SEARCHED).write.mode("overwrite").parquet(path))


SEARCH_SQL = "SELECT '{q}' AS query, doc_id, source FROM documents WHERE contains(lower(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' || coalesce(text, '')), lower('{q}'))"
SEARCHES = ("7 EN src13 ", "pathetic ", "qq##zz", "7 ")


@registered(" UNION ALL ".join(SEARCH_SQL.format(q=q.strip()) for q in SEARCHES))
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents and their fields searched through the trigrams of each file; the last query is too short for them."""
    rows, index = _searchable(spark, sf_dir)
    out = None
    for q in SEARCHES:
        found = layouts.indexed_search(rows, index, q, SEARCHED)[0].select(F.lit(q.strip()).alias("query"), "doc_id", "source")
        out = found if out is None else out.unionByName(found)
    return out


# ---- counts


@registered("""
WITH e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, date_trunc('day', ts)::TIMESTAMP AS day, CASE WHEN event_id % 9 <> 0 THEN user_id END AS u FROM events)
SELECT 'hour' AS level, hour AS at, count(DISTINCT coalesce(u, -1)) AS n, count(DISTINCT u) AS present FROM e GROUP BY hour
UNION ALL SELECT 'day', day, count(DISTINCT coalesce(u, -1)), count(DISTINCT u) FROM e GROUP BY day
UNION ALL SELECT 'all', NULL, count(DISTINCT coalesce(u, -1)), count(DISTINCT u) FROM e""")
def distinct_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by hour, by day and in all, from bitmaps stored by hour; absent users are one value, or none."""
    user = F.when(F.col("event_id") % 9 != 0, F.col("user_id"))

    def write(path: str) -> None:
        bitmaps.presence(table(spark, sf_dir, "events"), user, hour=F.date_trunc("hour", "ts").cast("timestamp_ntz")).write.mode("overwrite").parquet(path)

    bits = stored(spark, sf_dir, "presence", write).withColumn("day", F.date_trunc("day", "hour").cast("timestamp_ntz"))
    out = None
    for level, by in (("hour", ["hour"]), ("day", ["day"]), ("all", [])):
        both = bitmaps.distinct_counts(bits, *by), bitmaps.distinct_counts(bits, *by, name="present", null_counts=False)
        joined = both[0].join(both[1], by) if by else both[0].join(F.broadcast(both[1]), F.lit(True))  # one row each
        part = joined.select(F.lit(level).alias("level"), (F.col(by[0]) if by else F.lit(None).cast("timestamp_ntz")).alias("at"), "n", "present")
        out = part if out is None else out.unionByName(part)
    return out


@registered("""
WITH d AS (SELECT DISTINCT lang, source FROM documents UNION ALL SELECT lang, 'again ' || (length(text) % 50) FROM documents)
SELECT lang, count(DISTINCT source) AS n FROM d GROUP BY lang""")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that aren't numbers are numbered first."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("lang", "source").unionByName(docs.select("lang", F.concat(F.lit("again "), F.char_length("text") % 50).alias("source")))
    numbers = bitmaps.numbered_values(rows, "source")
    return bitmaps.distinct_counts(bitmaps.presence(rows.join(numbers, "source", "left"), F.col("number"), lang=F.col("lang")), "lang")


@registered("""
(SELECT 'user' AS kind, user_id::VARCHAR AS key, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 6)
UNION ALL (SELECT 'skewed', CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_id::VARCHAR END, count(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, min(event_id) LIMIT 1)
UNION ALL (SELECT 'flat', event_id::VARCHAR, count(*) AS n FROM events GROUP BY event_id ORDER BY n DESC, event_id LIMIT 6)""")
def sketched_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent of a few keys, of one hot key among many, and of keys that are all different, where all must be counted."""
    events = table(spark, sf_dir, "events")
    asked = {"user": (F.col("user_id"), 6), "skewed": (F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_id").cast("string")), 1), "flat": (F.col("event_id"), 6)}
    out = None
    for kind, (key, k) in asked.items():
        top = heavy.exact_top(events, key, k, "key", F.col("event_id") if kind == "skewed" else None, tracked=1000)[0]
        part = top.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@registered("""
WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1),
m AS (SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS applied FROM lineitem GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_nationkey % 5 END::INTEGER AS register_assets, coalesce(c.n, 0) AS chains, coalesce(a.n, 0) AS alerts,
       coalesce(m.n, 0) AS mitigations, coalesce(m.applied, 0) AS mitigations_applied
FROM customer LEFT JOIN c ON c.k = c_custkey LEFT JOIN a ON a.k = c_custkey LEFT JOIN m ON m.k = c_custkey""")
def site_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four figures of each site: assets of its register, chains, alerts, and mitigations with the applied ones."""
    register = F.when(F.col("c_custkey") % 4 == 0, F.lit("no register")).otherwise(F.to_json(F.struct(F.array_repeat(F.lit("a"), F.pmod("c_nationkey", F.lit(5)).cast("int")).alias("assets"))))
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), register.alias("register"))
    chains, alerts = (table(spark, sf_dir, t).select(F.col(c).alias("site_id")) for t, c in (("orders", "o_custkey"), ("events", "user_id")))
    mitigations = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site_id"), (F.col("l_returnflag") == "R").alias("applied"))
    return assistant.site_context(sites, chains, alerts, mitigations, F.col("register")).drop("register")


# ---- lists and hours


@registered("""
WITH r AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS parent, event_id, row_number() OVER (PARTITION BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT parent, k // 50 AS page, string_agg(event_id::VARCHAR, ',' ORDER BY k) AS children FROM r GROUP BY 1, 2""")
def paged_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of their assets, 50 a page; one asset has a third of all."""
    logs = table(spark, sf_dir, "events").withColumn("parent", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id")))
    out = pages.paged(logs, "parent", ["ts", "event_id"], "event_id", 50)
    return out.select("parent", "page", F.array_join(F.transform("children", lambda k: k.cast("string")), ",").alias("children"))


NOW = "2024-01-20 10:30:00"
SLOTS_SQL = f"""
WITH h AS (SELECT unnest(generate_series(0, 23)) AS slot),
e AS (SELECT user_id, 23 - (epoch(date_trunc('hour', TIMESTAMP '{NOW}')) - epoch(date_trunc('hour', ts)))::BIGINT // 3600 AS slot FROM events WHERE date_trunc('hour', ts) BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}'),
u AS (SELECT DISTINCT user_id FROM e),
c AS (SELECT u.user_id, h.slot, count(e.slot) AS n FROM u CROSS JOIN h LEFT JOIN e ON e.user_id = u.user_id AND e.slot = h.slot GROUP BY 1, 2)
SELECT user_id, string_agg(n::VARCHAR, ',' ORDER BY slot) AS counts, sum(n)::BIGINT AS total, max(n)::BIGINT AS peak FROM c GROUP BY user_id"""


def _said(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"), "total", "peak")


@registered(SLOTS_SQL)
def hour_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 counts of each user up to a given time, and their peak; a row of the year 1 and one of 9999 change nothing."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    stray = rows.limit(1).select("user_id", F.explode(F.array(F.lit("0001-01-02 00:00:00").cast("timestamp"), F.lit("9999-12-30 00:00:00").cast("timestamp"))).alias("ts"))
    return _said(slots.hour_slots(rows.unionByName(stray), "ts", F.lit(NOW).cast("timestamp"), "user_id"))


@registered(SLOTS_SQL)
def hour_slots_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream: hours are counted as they close, and the last 24 are read from what is stored."""
    root = scratch(spark, "hours")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.orderBy("ts").coalesce(3).write.parquet(f"{root}/in")
    rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 2 days")).alias("ts")).write.mode("append").parquet(f"{root}/in")
    for _ in range(2):  # a restart finds nothing to add
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        live.follow(slots.hourly_windows(stream, "ts", "user_id"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint", once=True).awaitTermination()
    hours = spark.read.parquet(f"{root}/out").where("user_id IS NOT NULL")
    return _said(slots.hour_slots(hours, "hour", F.lit(NOW).cast("timestamp"), "user_id", F.col("n")))


# ---- copies across ticks


@registered("SELECT event_id, 'first' AS copy, event_id * 2 AS ordinal, ts FROM events")
def stream_first_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, the copy of the lower ordinal a tick later; after each tick the stream is stopped and started again."""
    root = scratch(spark, "first")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    period = F.floor(F.dayofmonth("ts") / 11)  # three of ten days each
    copies = [rows.select("event_id", F.lit(name).alias("copy"), (F.col("event_id") * 2 + extra).alias("ordinal"), "ts", (period + extra).alias("tick")) for name, extra in (("late", 1), ("first", 2))]
    both = copies[0].unionByName(copies[1].withColumn("ordinal", F.col("event_id") * 2))
    schema = "event_id long, copy string, ordinal long, ts timestamp"
    for tick in range(1, 5):
        both.where(F.col("tick") == tick).drop("tick").write.mode("append").parquet(f"{root}/in")
        if tick == 4:  # the feed goes on: a later log closes the days before
            rows.agg(F.max("ts").alias("ts")).selectExpr("-1L AS event_id", "'later' AS copy", "-1L AS ordinal", "ts + INTERVAL 60 DAYS AS ts").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")  # a tick is a micro-batch, of as many files as were written
        out = first_seen.first_by_key(stream, "event_id", "ordinal", "ts", "25 days")
        first_seen.follow_first(spark, out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").where("event_id >= 0").select("event_id", "copy", "ordinal", F.col("ts").cast("timestamp_ntz").alias("ts"))
