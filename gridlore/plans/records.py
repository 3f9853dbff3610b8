"""Registered queries over records, registers, snapshots, threads and labels; orders, events and the rest stand for them."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions import settings
from gridlore.functions import text as X
from gridlore.operators import assistant, graph, joins, kpis, merge, register, search
from gridlore.operators.ordinals import numbered_all
from gridlore.plans.registry import registered, scratch
from gridlore.sources import readers
from gridlore.sources.readers import table
from gridlore.streaming import live

STRIP_SQL = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
SPACE_SQL = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


# ---- records of a tenant


@registered("SELECT o_orderstatus, o_orderkey, row_number() OVER (ORDER BY o_orderkey)::INTEGER AS row_number FROM orders WHERE o_orderstatus = 'O'")
def tenant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of one tenant by id, with their place."""
    mine = search.tenant(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), "O", "o_orderstatus")
    return numbered_all(mine, "o_orderkey", name="row_number").select("o_orderstatus", "o_orderkey", F.col("row_number").cast("int").alias("row_number"))


@registered("""
SELECT 'chains' AS part, o_orderkey AS record_id, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'c' || o_orderkey END, ''), 'ext-' || o_orderkey) AS id, o_orderpriority AS label, NULL AS status FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'mitigations', o_orderkey, 'm' || o_orderkey, NULL, CASE WHEN o_custkey % 2 = 0 THEN 'implemented' WHEN o_orderkey % 5 = 0 THEN 'proposed' ELSE 'approved' END FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'alerts', o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'ext-' || o_orderkey ELSE 'a' || o_orderkey END, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority || ': ' || o_custkey END, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 't1' END FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'fetched', count(*), 'logs', 'true', NULL FROM orders WHERE false""")
def persisted_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads of a tenant as a snapshot: three lists, no logs, fetched now. Some alerts are no JSON or have no id of their own."""
    rows = table(spark, sf_dir, "orders")
    own = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "").otherwise(F.concat(F.lit("c"), F.col("o_orderkey")))
    base = rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("site_id"), F.concat(F.lit("ext-"), F.col("o_orderkey")).alias("external_id"), "o_custkey", "o_orderpriority", own.alias("own"))
    chains = base.withColumn("payload", F.to_json(F.struct(F.col("own").alias("id"), F.col("o_orderpriority").alias("name")))).drop("o_custkey")
    status = F.when(F.pmod("id", F.lit(5)) == 0, "").otherwise("approved")
    mitigations = base.withColumn("payload", F.to_json(F.struct(F.concat(F.lit("m"), F.col("id")).alias("id"), status.alias("status")))).withColumns({"applied": F.pmod("o_custkey", F.lit(2)) == 0, "applied_at": F.lit(None).cast("timestamp")})
    alert = F.struct(F.when(F.pmod("id", F.lit(4)) != 0, F.concat(F.lit("a"), F.col("id"))).alias("id"), F.concat("o_orderpriority", F.lit(": "), "o_custkey").alias("message"), F.array(F.lit("t1")).alias("techniqueIds"))
    alerts = base.withColumn("payload", F.when(F.pmod("id", F.lit(7)) == 0, F.when(F.pmod("id", F.lit(4)) == 0, "no json").otherwise(F.to_json(F.struct(F.concat(F.lit("a"), F.col("id")).alias("id"))))).otherwise(F.to_json(alert))).select("id", "site_id", "external_id", "payload")
    snap = readers.persisted_snapshot(chains, alerts, mitigations, "F")
    out = snap.chains.select(F.lit("chains").alias("part"), F.col("persistedRecordId").alias("record_id"), "id", F.col("name").alias("label"), F.lit(None).cast("string").alias("status"))
    out = out.unionByName(snap.mitigations.select(F.lit("mitigations").alias("part"), F.col("persistedRecordId").alias("record_id"), "id", F.lit(None).cast("string").alias("label"), "status"))
    out = out.unionByName(snap.alerts.select(F.lit("alerts").alias("part"), F.col("persistedRecordId").alias("record_id"), "id", F.col("message").alias("label"), F.get("techniqueIds", F.lit(0)).alias("status")))
    now = F.abs(F.unix_timestamp(snap.fetched_at) - F.lit(int(time.time()))) < 3600  # of this run, not only some time
    logs = snap.logs.agg(F.count("*").alias("record_id")).select(F.lit("fetched").alias("part"), "record_id", F.lit("logs").alias("id"), now.cast("string").alias("label"), F.lit(None).cast("string").alias("status"))
    return out.unionByName(logs)


@registered("""
SELECT 'hit' AS probe, o_orderkey FROM orders WHERE o_orderkey = 11 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 11)
UNION ALL SELECT 'other tenant', o_orderkey FROM orders WHERE o_orderkey = 11 AND o_custkey = -1
UNION ALL SELECT 'deep link', o_orderkey FROM orders WHERE o_orderkey = 12""")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record by id and tenant: its own tenant finds it, another does not; a link names the id alone."""
    rows = table(spark, sf_dir, "orders")
    owner = rows.where("o_orderkey = 11").select("o_custkey").first()[0]
    hit, miss = (search.lookup(rows, site, 11, "o_custkey", "o_orderkey") for site in (owner, -1))
    link = rows.where(search.equals("o_orderkey", "12"))
    return hit.select(F.lit("hit").alias("probe"), "o_orderkey").unionByName(miss.select(F.lit("other tenant").alias("probe"), "o_orderkey")).unionByName(link.select(F.lit("deep link").alias("probe"), "o_orderkey"))


@registered("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def username_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name asked for has a tab and a newline around it."""
    sites = table(spark, sf_dir, "customer").withColumn("username", F.col("c_name"))
    return search.by_username(sites, "\tCustomer#000000007 \n").select("c_custkey", "c_name")


@registered("SELECT c_custkey AS id, c_name AS username, c_mktsegment AS site_name FROM customer")
def public_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("site_name"), F.col("c_acctbal").alias("password_hash"), F.lit("x").alias("new_secret"))
    return search.public(sites)


@registered("""
SELECT s_name AS username, s_nationkey AS nation FROM supplier
UNION ALL SELECT c_name, c_nationkey FROM (SELECT replace(c_name, 'Customer', 'Supplier') AS c_name, c_nationkey FROM customer) WHERE c_name NOT IN (SELECT s_name FROM supplier)""")
def seed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are seeds of suppliers; those whose name a supplier has stay out."""
    sites = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("username"), F.col("s_nationkey").alias("nation"))
    seeds = table(spark, sf_dir, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("username"), F.col("c_nationkey").alias("nation"))
    return readers.seed(sites, seeds)


@registered("""
SELECT o_orderkey::VARCHAR AS external_id, CASE WHEN o_orderkey % 2 = 0 THEN 'again' ELSE o_orderpriority END AS payload, o_orderkey % 3 = 0 AS applied,
       CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_answers, 1::BIGINT AS n_ids, 1::BIGINT AS n_records FROM orders
UNION ALL SELECT NULL, o_orderpriority, false, count(*), count(*), count(*) FROM orders GROUP BY o_orderpriority""")
def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second record is ingested again: its payload is replaced, its id and its applied flag stay. Then every payload comes
    without an external id, many of them equal: each is a record of its own. Ids are counted in the log and in the answers."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site_id"), F.col("o_orderkey").cast("string").alias("external_id"), F.col("o_orderpriority").alias("payload"), F.lit(0).alias("at"))
    log, first = merge.ingested(rows.limit(0).withColumn("id", F.lit("")), rows)
    again = rows.where(F.pmod(F.col("external_id").cast("long"), F.lit(2)) == 0).withColumns({"payload": F.lit("again"), "at": F.lit(1)})
    log, second = merge.ingested(log, again)
    flags = log.where(F.pmod(F.col("external_id").cast("long"), F.lit(3)) == 0).select(F.col("id").alias("record_id"), F.lit(True).alias("applied"), F.lit(0).alias("at"))
    unnamed = rows.select(F.lit(1).cast("long").alias("site_id"), F.lit(None).cast("string").alias("external_id"), "payload", F.lit(2).alias("at"))
    log, third = merge.ingested(log, unnamed)
    state = merge.applied_state(merge.latest(log, ["site_id", "external_id"], ["at"]), flags.distinct())
    answers = first.unionByName(second).unionByName(third).groupBy(F.col("persistedRecordId").alias("id")).agg(F.count_if("ok").alias("answers"))
    of = ["external_id", "payload", "applied"]  # of records that have no external id the payload is all there is
    counted = state.join(answers, "id").groupBy(*of).agg(F.sum("answers").alias("n_answers"), F.count("*").alias("n_records"))
    ids = log.groupBy("external_id", F.when(F.col("external_id").isNull(), F.col("payload")).alias("__p")).agg(F.count_distinct("id").alias("n_ids"))
    same = F.col("c.external_id").eqNullSafe(F.col("i.external_id")) & F.when(F.col("c.external_id").isNull(), F.col("c.payload")).eqNullSafe(F.col("i.__p"))
    return counted.alias("c").join(ids.alias("i"), same).select(*[f"c.{c}" for c in of], "n_answers", "n_ids", "n_records")


@registered("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported as JSON lines and read again."""
    path, rows = scratch(spark, "export"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    readers.export_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


# ---- registers and snapshots as JSON


PAGE = 30_000  # ids that a page of a snapshot spans: one task holds a page whole, never a snapshot


def _page_of(number: Column, size: int = PAGE) -> Column:
    """The first number of the page that a number is on."""
    return number - F.pmod(number, F.lit(size))


def _paged_snapshots(events: DataFrame, *fields: Column, size: int = PAGE) -> DataFrame:
    """(batch, value): three snapshots, each of every third event as a log by its id, as pages of JSON that say where they begin."""
    log = F.struct("event_id", F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("level")).alias("row"))
    ordered = F.transform(F.array_sort(F.collect_list(log)), lambda x: x["row"])
    pages = events.groupBy(F.pmod("event_id", F.lit(3)).cast("int").alias("batch"), _page_of(F.col("event_id"), size).alias("offset")).agg(ordered.alias("logs"))
    return pages.select("batch", F.to_json(F.struct(*fields, "offset", "logs")).alias("value"))


@registered("""
SELECT c_nationkey AS site, 'a' || c_custkey AS asset_id, 'Level ' || (c_custkey % 6) AS zone, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INTEGER AS row_number
FROM customer WHERE c_nationkey % 5 <> 0""")
def register_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One register a nation as a JSON text, every fifth cut off in the middle: those have no rows."""
    asset = F.struct(F.concat(F.lit("a"), F.col("c_custkey")).alias("asset_id"), F.concat(F.lit("Level "), F.pmod("c_custkey", F.lit(6))).alias("zone"), F.col("c_nationkey").cast("string").alias("hostname"))
    whole = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(asset).alias("assets"))).alias("value"))
    whole = whole.withColumn("value", F.when(F.col("c_nationkey") % 5 == 0, F.left("value", F.char_length("value") - 3)).otherwise(F.col("value")))
    rows = register.sheet(readers.sheets_of(whole), "assets").withColumns({"site": F.col("hostname").cast("int"), "__k": F.substring("asset_id", 2, 20).cast("long")})
    return register.numbered(rows, ["__k"], "site").select("site", "asset_id", "zone", "row_number")


@registered("SELECT event_id::VARCHAR AS id, event_type AS source FROM events WHERE event_type <> 'view'")
def snapshot_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots for each kind of event, a page of ids each; those of views have an object where the list should be and so no rows."""
    log = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("source"), F.lit(1).alias("unknown"))
    lists = table(spark, sf_dir, "events").groupBy("event_type", _page_of(F.col("event_id")).alias("page")).agg(F.collect_list(log).alias("logs"))
    listed, single = F.to_json(F.struct("logs")), F.to_json(F.struct(F.struct(F.lit("x").alias("id")).alias("logs")))
    whole = lists.select(F.when(F.col("event_type") == "view", single).otherwise(listed).alias("value"))
    return readers.snapshot_part(whole, "logs").select("id", "source")


@registered("""
SELECT id, name, first_source FROM (
  SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey < 3 THEN 'demo ' || n_nationkey ELSE n_name END AS name, 0 AS first_source FROM nation
  UNION ALL SELECT 'demo', 'only in the demo', 1)""")
def demo_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo rows come last and win over stored ones of the same id."""
    stored = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"))
    blank = (None,) * 13
    demo = readers.fixture(spark, {"chains": [(f"n{k}", f"demo {k}", *blank) for k in range(3)] + [("demo", "only in the demo", *blank)]})
    out = merge.merge_entities(stored, demo.chains)
    return out.select("id", "name", F.col("position.__source").alias("first_source"))


@registered("""
WITH e AS (SELECT *, event_id % 3 AS batch FROM events),
a AS (SELECT user_id, arg_max(event_type, batch * 100000000 + event_id) AS level, min(batch * 100000000 + event_id) AS f FROM e GROUP BY user_id)
SELECT user_id::VARCHAR AS id, level, row_number() OVER (ORDER BY f)::INTEGER AS place FROM a""")
def snapshot_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots dropped one by one into a folder, followed with a restart: last content, at the place of the first appearance."""
    root = scratch(spark, "snapshots")
    snaps = _paged_snapshots(table(spark, sf_dir, "events"))
    for k in range(3):
        snaps.where(F.col("batch") == k).select("value").write.mode("append").text(f"{root}/in")
        table_ = live.MergedTable(spark, f"{root}/out", "id", "ord", compact_every=2)
        stream = readers.snapshot_stream(spark, f"{root}/in", "logs", files_per_batch=None, offset="offset", lines=True)
        live.follow(stream, table_.absorb, f"{root}/checkpoint", once=True).awaitTermination()
    merged = live.MergedTable(spark, f"{root}/out", "id", "ord").read()
    return numbered_all(merged, "position", name="place").select("id", "level", F.col("place").cast("int").alias("place"))


@registered("""
WITH e AS (SELECT *, event_id % 3 AS batch, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS fetched FROM events),
a AS (SELECT user_id, arg_max(event_type, fetched * 100000000 + event_id) AS level, min(fetched * 100000000 + event_id) AS f FROM e GROUP BY user_id)
SELECT user_id::VARCHAR AS id, level, row_number() OVER (ORDER BY f)::INTEGER AS place FROM a""")
def snapshots_by_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that arrive in another order than they were fetched in: the one fetched last wins, the first one gives the place."""
    root = scratch(spark, "fetched")
    when = F.get(F.array(*[F.lit(f"2024-03-0{d}T12:00:00Z") for d in (3, 1, 2)]), F.col("batch"))
    snaps = _paged_snapshots(table(spark, sf_dir, "events"), when.alias("fetchedAt"))
    merged = live.MergedTable(spark, f"{root}/out", "id", "ord", compact_every=2, fetched="fetched_at")
    for k in range(3):
        snaps.where(F.col("batch") == k).select("value").write.mode("append").text(f"{root}/in")
        stream = readers.snapshot_stream(spark, f"{root}/in", "logs", files_per_batch=None, fetched="fetched_at", offset="offset", lines=True)
        live.follow(stream, merged.absorb, f"{root}/checkpoint", once=True).awaitTermination()
    return numbered_all(merged.read(), "position", name="place").select("id", "level", F.col("place").cast("int").alias("place"))


@registered("SELECT event_id, event_type FROM events")
def stream_distinct_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice within the delay, in two micro-batches with a restart between them, and stays once."""
    root, rows = scratch(spark, "distinct"), table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for _ in range(2):
        rows.write.mode("append").parquet(f"{root}/in")
        stream = live.distinct_within(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "event_id", "ts", "90 days")
        live.follow(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type")


@registered("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END, n_nationkey)::INTEGER AS stat FROM nation")
def prefer_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    live_value = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", merge.prefer(live_value, F.col("n_nationkey")).alias("stat"))


@registered("""
WITH f AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS demo, o_custkey % 3 = 0 AS persisted_ok, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus = 'O' END AS health_ok, o_orderpriority < '3' AS snapshot_ok, o_totalprice > 200000 AS has_rows, o_orderkey % 5 = 0 AS refreshing FROM orders),
s AS (SELECT *, CASE WHEN demo THEN CASE WHEN persisted_ok THEN 'demo' ELSE 'offline' END WHEN coalesce(health_ok, false) AND snapshot_ok THEN 'connected' WHEN has_rows THEN 'persisted' WHEN health_ok THEN 'degraded' ELSE 'offline' END AS state FROM f)
SELECT o_orderkey, state, CASE WHEN refreshing AND NOT persisted_ok AND demo THEN 'loading' ELSE state END AS shown FROM s""")
def connection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each site after a refresh, and what is shown while the next one runs; silent ones show nothing."""
    c = F.col
    flags = {"demo": F.pmod("o_orderkey", F.lit(2)) == 0, "persisted_ok": F.pmod("o_custkey", F.lit(3)) == 0, "health_ok": F.when(F.pmod("o_orderkey", F.lit(7)) != 0, c("o_orderstatus") == "O"), "snapshot_ok": c("o_orderpriority") < "3", "has_rows": c("o_totalprice") > 200000}
    rows = table(spark, sf_dir, "orders").withColumns(flags)
    rows = rows.withColumn("state", settings.connection_state_of(*[c(f) for f in flags]))
    return rows.select("o_orderkey", "state", settings.shown_state_of(c("state"), F.pmod("o_orderkey", F.lit(5)) == 0, c("demo"), c("persisted_ok")).alias("shown"))


@registered("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'http://site' || c_custkey ELSE 'http://d' END AS url, CASE WHEN c_custkey % 6 = 0 THEN c_nationkey ELSE 8 END::INTEGER AS timeout,
       CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN c_mktsegment ELSE 'a,b' END AS layers, 1 AS kept FROM customer""")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of each site: its own ones, as JSON, over the defaults; a list replaces the list, others have no settings."""
    k = F.col("c_custkey")
    own = F.struct(F.struct(F.concat(F.lit("http://site"), k).alias("url"), F.when(k % 3 == 0, F.col("c_nationkey")).alias("timeout")).alias("engine"), F.when(k % 3 == 0, F.array("c_mktsegment")).alias("layers"))
    text = F.when(k % 2 == 0, F.to_json(own))
    schema = T.StructType.fromDDL("engine struct<url: string, timeout: int>, layers array<string>, kept int")
    base = F.from_json(F.lit('{"engine": {"url": "http://d", "timeout": 8}, "layers": ["a", "b"], "kept": 1}'), schema)
    rows = table(spark, sf_dir, "customer").withColumns({"base": base, "own": F.from_json(text, schema)})
    s = rows.select("c_custkey", settings.merged_struct(F.col("base"), F.col("own"), schema).alias("s"))
    return s.select("c_custkey", "s.engine.url", "s.engine.timeout", F.array_join("s.layers", ",").alias("layers"), "s.kept")


@registered("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'http://host' || c_custkey || ':9000' WHEN 1 THEN 'https://host' || c_custkey || '/X/y' WHEN 2 THEN 'http://d' WHEN 3 THEN 'http://d' WHEN 4 THEN 'http://d' ELSE 'http://other:8000' END AS url FROM customer""")
def engine_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as people type them: without a scheme, with slashes, capitals and usual ports, none at all, or this machine's reserved port."""
    k = F.col("c_custkey")
    said = F.when(k % 6 == 0, F.concat(F.lit(" host"), k, F.lit(":9000// "))).when(k % 6 == 1, F.concat(F.lit("HTTPS://Host"), k, F.lit(":443/X/y/?q"))).when(k % 6 == 2, F.lit("\t")).when(k % 6 == 3, "localhost:8000").when(k % 6 == 4, "http://127.0.0.1:8000/a").otherwise("other:8000")
    return table(spark, sf_dir, "customer").select("c_custkey", settings.engine_url_of(said, "http://d").alias("url"))


# ---- facets and search


@registered("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND list_contains(string_split(p_name, ' '), 'ring')")
def alert_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("tactics", F.split("p_name", " "))
    return search.facets(rows, {"p_brand": "Brand#2", "p_type": "all"}, {"tactics": "ring"}).select("p_partkey")


@registered("""
SELECT p_partkey FROM part WHERE p_size > 10 AND contains(lower(p_name || ' ' || p_type || ' ' || p_partkey || ' ' || coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, '') || '   ' || array_to_string(string_split(p_name, ' '), ' ')), 'ring economy 1')""")
def mitigation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine fields, one of them null at times; the query crosses three of them."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").withColumns({"title": F.col("p_name"), "rationale": F.col("p_type"), "id": F.col("p_partkey"), "chainId": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), "kgMitigationId": none, "kgMitigationName": none})
    rows = rows.withColumns({"appliesToAssets": F.split("p_name", " "), "appliesToTechniques": F.array().cast("array<string>"), "appliesToZones": F.lit(None).cast("array<string>"), "status": F.when(F.col("p_size") > 10, "open")})
    return search.text_search(search.facets(rows, {"status": "open"}), "Ring ECONOMY 1", *search.MITIGATION_FIELDS).select("p_partkey")


@registered("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderkey || ' t1 t2 ' || o_custkey), 't2 9')""")
def chain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumns({"name": F.col("o_orderpriority"), "summary": F.col("o_orderstatus"), "id": F.col("o_orderkey"), "techniques": F.array(F.lit("T1")), "tactics": F.array(F.lit("T2")), "targetAssets": F.array(F.col("o_custkey").cast("string"))})
    return search.text_search(search.facets(rows, {"o_orderstatus": "O"}), " t2 9 ", *search.CHAIN_FIELDS).select("o_orderkey")


@registered("SELECT count(*) AS running, 0::BIGINT AS paused FROM events")
def paused_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    running, held = (search.paused(rows, p).agg(F.count("*").alias(n)) for p, n in ((False, "running"), (True, "paused")))
    return running.crossJoin(F.broadcast(held))  # one row each


@registered(rf"""
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN chr(9) || chr(10) WHEN 1 THEN '  ' ELSE chr(9) || coalesce(text, '') || chr(10) END AS title FROM conversations)
SELECT conv_id, turn, length(title) BETWEEN 1 AND 512 AND {STRIP_SQL.format(c="title")} <> '' AS valid FROM t""")
def validation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of tabs, newlines or blanks alone are not valid."""
    tab, line = F.lit("\t"), F.lit("\n")
    title = F.when(F.col("turn") % 4 == 0, F.concat(tab, line)).when(F.col("turn") % 4 == 1, "  ").otherwise(F.concat(tab, F.coalesce("text", F.lit("")), line))
    rows = table(spark, sf_dir, "conversations").withColumn("title", title)
    return rows.select("conv_id", "turn", search.validation("title", 1, 512).alias("valid"))


# ---- joins


@registered("SELECT c_custkey, count(o_orderkey) AS message_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def parent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders count 0."""
    return joins.with_counts(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderkey").select("c_custkey", "message_count")


@registered("""
SELECT o_orderkey AS alert_id, o_custkey || '/' || o_orderpriority AS mitigation_id FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_custkey % 3 <> 0 AND o_orderkey % 2 = 0""")
def alert_mitigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mitigation for each chain and priority names every second alert of it; every third chain does not exist."""
    orders = table(spark, sf_dir, "orders")
    alerts = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("chainId"))
    chains = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("id"))
    named = F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")))
    mitigations = orders.groupBy("o_custkey", "o_orderpriority").agg(named.alias("alertIds")).select(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("id"), F.col("o_custkey").cast("string").alias("chainId"), "alertIds")
    return joins.alert_mitigations(alerts, chains, mitigations).select(F.col("alert_id").cast("long").alias("alert_id"), "mitigation_id")


@registered("""
SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS alerts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def chain_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.to_many(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderkey", "alerts")
    return out.select("c_custkey", F.array_join(F.transform("alerts", lambda k: k.cast("string")), ",").alias("alerts"))


@registered("""
WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY o_custkey)
SELECT event_id, first_status FROM events LEFT JOIN f ON user_id = o_custkey""")
def log_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alert of a log's asset; none: null."""
    out = joins.to_one(table(spark, sf_dir, "events"), table(spark, sf_dir, "orders"), "user_id", "o_custkey", ["o_orderkey"], {"o_orderstatus": "first_status"})
    return out.select("event_id", "first_status")


@registered("""
WITH z AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Level 0' WHEN 1 THEN 'Enterprise' ELSE 'DMZ' END AS zone, CASE p_partkey % 3 WHEN 0 THEN 'L0' WHEN 1 THEN 'L4' ELSE 'DMZ' END AS layer FROM part WHERE p_partkey % 10 <> 9),
e AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_partkey + l_suppkey AS b, l_returnflag FROM lineitem)
SELECT l_orderkey, l_linenumber, a, b, coalesce(s.layer, 'L2') AS source_layer, coalesce(t.layer, 'L2') AS target_layer, coalesce(s.layer, 'L2') <> coalesce(t.layer, 'L2') AS cross_layer,
       l_returnflag = 'R' AS critical FROM e LEFT JOIN z s ON s.p_partkey = a LEFT JOIN z t ON t.p_partkey = b""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between assets, some of which are not in the register; each asset is listed twice, its first row counts."""
    zone = F.when(F.col("p_partkey") % 3 == 0, "Level 0").when(F.col("p_partkey") % 3 == 1, "Enterprise").otherwise("DMZ")
    known = table(spark, sf_dir, "part").where("p_partkey % 10 <> 9").select(F.col("p_partkey").alias("asset_id"), zone.alias("zone"), F.lit(0).alias("ord"))
    assets = known.unionByName(known.withColumns({"zone": F.lit("Level 1"), "ord": F.lit(1)}))
    links = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_asset_id"), (F.col("l_partkey") + F.col("l_suppkey")).alias("destination_asset_id"), F.when(F.col("l_returnflag") == "R", "Critical").alias("reliability"), F.lit("TLS").alias("security_level")
    )
    out = graph.edges(links, assets, "ord")
    return out.select("l_orderkey", "l_linenumber", F.col("source_asset_id").alias("a"), F.col("destination_asset_id").alias("b"), "source_layer", "target_layer", "cross_layer", "critical")


# ---- counts, buckets, order


@registered("""
WITH k AS (SELECT coalesce(CASE WHEN event_id % 4 <> 0 THEN user_id::VARCHAR END, 'undefined') AS key FROM events), c AS (SELECT key, count(*) AS n FROM k GROUP BY key ORDER BY n DESC, key LIMIT 6)
SELECT key, n, coalesce(c_name, key) AS name FROM c LEFT JOIN customer ON c_custkey::VARCHAR = key AND c_custkey % 2 = 0""")
def top_assets_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six busiest assets, absent ones counted as one, with the names that are known."""
    asset = F.when(F.col("event_id") % 4 != 0, F.col("user_id"))
    return kpis.top_named(table(spark, sf_dir, "events"), asset, 6, table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), "c_custkey", "c_name")


@registered("SELECT event_type, greatest(coalesce(max(CASE WHEN event_type <> 'view' THEN -value END), 0), 0)::DOUBLE AS top FROM events GROUP BY event_type")
def floored_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") != "view", -F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(kpis.floor_max(value).alias("top"))


@registered("""
WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey)
SELECT o_custkey, greatest(f + o, 1)::BIGINT AS total FROM c""")
def map_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over a map; nothing in it gives the denominator 1."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.create_map(F.lit("f"), F.count_if(F.col("o_orderstatus") == "F"), F.lit("o"), F.count_if(F.col("o_orderstatus") == "O")).alias("m"))
    return counts.select("o_custkey", kpis.map_total(F.col("m")).alias("total"))


@registered("""
WITH r AS (SELECT o_orderkey, CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 2 END::INTEGER AS rank FROM orders),
n AS (SELECT rank, count(*) AS n FROM r GROUP BY rank), p AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY o_orderkey) AS k FROM r)
SELECT n.rank, n.n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members FROM n JOIN p ON n.rank = p.rank WHERE k <= 25 GROUP BY n.rank, n.n""")
def priority_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets by rank with their size, and the first 25 of each for the page."""
    rank = kpis.priority_rank(F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))))
    out = kpis.bucket_page(table(spark, sf_dir, "orders"), rank, "o_orderkey", "o_orderkey", 25)
    return out.select("rank", "n", F.array_join(F.transform("members", lambda k: k.cast("string")), ",").alias("members"))


@registered("""
WITH l AS (SELECT unnest(['L0', 'L1', 'L2', 'L3', 'L4', 'DMZ']) AS layer), a AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'L0' WHEN p_partkey % 4 = 1 THEN 'DMZ' ELSE 'L2' END AS layer, count(*) AS n FROM part GROUP BY 1)
SELECT l.layer, coalesce(n, 0)::BIGINT AS n FROM l LEFT JOIN a ON l.layer = a.layer""")
def assets_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("p_partkey") % 4 == 0, "Process").when(F.col("p_partkey") % 4 == 1, "a DMZ").when(F.col("p_partkey") % 4 == 2, "elsewhere")
    return graph.assets_per_layer(table(spark, sf_dir, "part").withColumn("zone", zone))


@registered("SELECT true AS some, false AS none")
def any_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return spark.createDataFrame([(kpis.has_rows(rows.limit(0), rows), kpis.has_rows(rows.limit(0), rows.where("false")))], "some boolean, none boolean")


@registered("SELECT event_id, ts FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts END AS ts FROM events) ORDER BY ts DESC NULLS LAST, event_id LIMIT 50")
def alerts_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of alerts, newest first; those without a time come last."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("ts"))
    return kpis.newest_first(rows, "ts", "event_id").limit(50)


@registered("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id LIMIT 50")
def logs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.newest_first(search.facets(table(spark, sf_dir, "events"), {"event_type": "error"}), "ts", "event_id").select("event_id", "ts").limit(50)


@registered("""
SELECT c_custkey AS id, c_acctbal AS updated_at, count(o_orderkey) AS message_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY updated_at DESC, id LIMIT 40""")
def threads_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of threads, last updated first."""
    threads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("updated_at"))
    messages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("conversation_id"))
    return assistant.thread_list(threads, messages.withColumnRenamed("id", "id"), "updated_at").limit(40)


@registered("""
WITH k AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS key FROM part)
SELECT key, row_number() OVER (ORDER BY lower(key), key DESC)::INTEGER AS place FROM k""")
def locale_ordered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names of JSON rows in locale order, whatever the case; of two that differ by case the lower one is first."""
    name = F.when(F.col("p_size") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    rows = table(spark, sf_dir, "part").select(F.to_json(F.map_from_arrays(F.array(name), F.array(F.lit(1)))).alias("json"))
    return numbered_all(register.column_keys(rows, "json"), register.locale_order("key"), "key", name="place").select("key", F.col("place").cast("int").alias("place"))


# ---- threads and messages


@registered(rf"""
WITH m AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS t FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, {SPACE_SQL.format(c="t")} AS t FROM m)
SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'own ' || conv_id ELSE CASE WHEN length(t) > 80 THEN left(t, 77) || '…' ELSE t END END AS title FROM s""")
def thread_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New threads take their title from the first user message; a third has one already."""
    rows = table(spark, sf_dir, "conversations")
    threads = rows.select(F.col("conv_id").alias("id")).distinct().withColumn("title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("own "), F.col("id"))).when(F.col("id") % 3 == 1, ""))
    return assistant.with_titles(threads, rows, "conv_id", "turn", "text")


@registered(rf"""
WITH n AS (SELECT c_custkey AS id, left({SPACE_SQL.format(c="CASE WHEN c_custkey % 5 = 0 THEN chr(9) || ' ' ELSE chr(9) || repeat(c_name || '  ', 40) END")}, 512) AS title FROM customer)
SELECT n.id, n.title, count(o_orderkey) AS message_count FROM n JOIN customer ON c_custkey = n.id LEFT JOIN orders ON o_custkey = n.id WHERE n.title <> '' AND c_nationkey = 3 GROUP BY n.id, n.title""")
def thread_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All threads are named anew by one tenant: only its own change, white titles change nothing, long ones are cut."""
    customers = table(spark, sf_dir, "customer")
    threads = customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("site_id"), F.lit("old").alias("title"))
    white, long = F.lit("\t "), F.concat(F.lit("\t"), F.repeat(F.concat("c_name", F.lit("  ")), F.lit(40)))
    names = customers.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, white).otherwise(long).alias("title"))
    messages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("conversation_id"))
    return assistant.renamed(threads, messages, names, 3).select("id", "title", "message_count")


@registered(rf"SELECT conv_id AS conversation_id, 'user' AS role, {STRIP_SQL.format(c='text')} AS content, turn AS created_at FROM conversations WHERE text IS NOT NULL")
def message_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null").withColumn("padded", F.concat(F.lit(" \t"), "text", F.lit("\n")))
    return assistant.said(rows, "conv_id", F.col("padded"), F.col("turn"))


@registered("SELECT 'db-' || event_id AS id, event_type, epoch_us(ts) // 1000 AS at FROM events")
def message_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assistant.shown(table(spark, sf_dir, "events"), ["event_id"], "ts").select("id", "event_type", "at")


@registered(rf"""
WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN chr(9) || chr(10) WHEN 1 THEN NULL ELSE ' ' || role || chr(9) END AS title FROM conversations)
SELECT conv_id, turn, coalesce(nullif({STRIP_SQL.format(c="title")}, ''), 'Conversation #' || conv_id) AS shown FROM t""")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("turn") % 3 == 0, "\t\n").when(F.col("turn") % 3 == 2, F.concat(F.lit(" "), "role", F.lit("\t")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.display_title(title, F.col("conv_id")).alias("shown"))


@registered(r"""
SELECT c_custkey, 'Site ' || c_name || ': ' || c_custkey || ' asset' || (CASE WHEN c_custkey = 1 THEN '' ELSE 's' END) || ', 1 attack chain, 0 alerts, 2 mitigation plans (' || c_nationkey || ' applied).' || chr(10)
       || CASE WHEN c_nationkey % 2 = 0 THEN 'Architecture: ' || c_mktsegment || chr(10) ELSE '' END || CASE WHEN c_nationkey % 3 = 0 THEN chr(10) || 'Earlier in this thread:' || chr(10) || 'User: hi' || chr(10) ELSE '' END
       || chr(10) || 'Question: ' || CASE WHEN c_custkey % 2 = 0 THEN repeat('q', 497) || '…' ELSE 'why?' END || chr(10) AS reply FROM customer""")
def template_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumns({"chains": F.lit(1), "alerts": F.lit(0), "mitigations": F.lit(2), "architecture": F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment"))})
    context = {"site_name": "c_name", "assets": "c_custkey", "chains": "chains", "alerts": "alerts", "mitigations": "mitigations", "applied": "c_nationkey", "architecture": "architecture"}
    question = F.when(F.col("c_custkey") % 2 == 0, F.repeat(F.lit("q"), F.lit(700))).otherwise("\n why?\t")
    past = F.when(F.col("c_nationkey") % 3 == 0, "User: hi").otherwise("")
    return rows.select("c_custkey", assistant.reply(context, question, past).alias("reply"))


# ---- texts, times, numbers, labels


@registered("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '—' WHEN 1 THEN p_name WHEN 2 THEN 'a, ' || p_brand WHEN 3 THEN '{"k":' || p_size || '}' WHEN 4 THEN '[{"k":1}]' ELSE '—' END AS cell FROM part""")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 6
    json = (
        F.when(kind == 0, F.lit("null")).when(kind == 1, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(kind == 2, F.concat(F.lit('["a","'), "p_brand", F.lit('"]')))
        .when(kind == 3, F.concat(F.lit('{"k":'), F.col("p_size").cast("string"), F.lit("}"))).when(kind == 4, F.lit('[{"k":1}]')).otherwise(F.lit("[]"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", X.cell_text(F.parse_json(json)).alias("cell"))


@registered("SELECT p_partkey, p_size || ' row' || CASE WHEN p_size = 1 THEN '' ELSE 's' END AS said FROM part")
def plurals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.plural(F.col("p_size"), "row").alias("said"))


@registered("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text is no time and parses to null."""
    said = F.when(F.col("event_id") % 3 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", X.parse_time(said).cast("timestamp_ntz").alias("at"))


@registered("SELECT event_id, coalesce(strftime(CASE WHEN event_id % 3 <> 0 THEN ts END, '%b %d, %H:%M:%S'), '—') AS shown FROM events")
def date_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", X.date_time(ts).alias("shown"))


@registered("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '—' ELSE (o_orderkey % 257 * 100 * 2 + 256) // 512 || '%' END AS whole,
       CASE WHEN o_orderkey % 4 = 0 THEN '—' ELSE ((o_orderkey % 257 * 1000 * 2 + 256) // 512) // 10 || '.' || ((o_orderkey % 257 * 1000 * 2 + 256) // 512) % 10 || '%' END AS one_digit FROM orders""")
def percent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of 256, which doubles hold exactly; some end in a half."""
    x = F.when(F.col("o_orderkey") % 4 != 0, F.pmod("o_orderkey", F.lit(257)) / 256.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.percent_text(x).alias("whole"), X.percent_text(x, 1).alias("one_digit"))


@registered("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'red' WHEN 'click' THEN 'amber' WHEN 'view' THEN 'faint' ELSE 'slate' END AS level_tone,
       CASE event_type WHEN 'view' THEN 'good' WHEN 'click' THEN 'degraded' ELSE 'other' END AS health,
       CASE event_type WHEN 'view' THEN 'green' WHEN 'click' THEN 'red' ELSE 'blue' END AS asset_tone,
       CASE event_type WHEN 'view' THEN 'orange' WHEN 'click' THEN 'green' ELSE 'gray' END AS criticality_tone FROM events""")
def console_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "error", "alert").when(kind == "click", "warn").when(kind == "view", "debug").when(kind == "purchase", "info")
    health = F.when(kind == "view", "Connected").when(kind == "click", "WARMING").otherwise("down")
    status = F.when(kind == "view", "Operational").when(kind == "click", "Offline")
    critical = F.when(kind == "view", "High").when(kind == "click", "Low").otherwise("?")
    return table(spark, sf_dir, "events").select(
        "event_id", X.level_tone(level).alias("level_tone"), X.health_tone(health).alias("health"), X.asset_tone(status).alias("asset_tone"), X.criticality_tone(critical).alias("criticality_tone")
    )
