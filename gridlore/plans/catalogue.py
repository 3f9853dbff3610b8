"""The registered queries, each an operator on a table of the same shape, with the SQL it must equal.

orders stand for alerts and chains, lineitem for steps and edges, customer for assets, part for zone names, conversations
for threads, events for logs and payloads. Every query reads its whole tables; limits are top-k features only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions import text as X
from gridlore.operators import assistant, graph, joins, kpis, merge, register, search
from gridlore.plans import records, scale  # noqa: F401 - they register their queries
from gridlore.plans.registry import QUERIES, SQL, registered, scratch
from gridlore.sources.readers import payload_id, table
from gridlore.streaming.live import MergedTable, follow

__all__ = ["QUERIES", "SQL"]

TITLE_SQL = r"""CASE WHEN length({c}) > 80 THEN left({c}, 77) || '…' ELSE {c} END"""
SPACE_SQL = r"""trim(regexp_replace({c}, '[ \t\n\r\f\v]+', ' ', 'g'))"""


@registered("""
SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors,
       count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS urgent,
       count(DISTINCT coalesce(user_id::VARCHAR, 'undefined')) AS distinct_users,
       count(DISTINCT event_type) FILTER (WHERE event_type <> '') AS distinct_types
FROM events""")
def kpi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of the page in one pass."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("total"), F.count_if(kind == "error").alias("errors"), F.count_if(kind.isin("error", "purchase")).alias("urgent"),
        kpis.distinct_values(F.col("user_id")).alias("distinct_users"), kpis.distinct_present(kind).alias("distinct_types"),
    )


@registered("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 6")
def topk_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.top_counts(table(spark, sf_dir, "events"), F.col("user_id"), 6, "user_id")


@registered("""
SELECT event_id, user_id, event_type, props FROM events
WHERE event_type = 'error'
  AND contains(lower(coalesce(event_id::VARCHAR, '') || ' ' || coalesce(event_type, '') || ' ' || coalesce(user_id::VARCHAR, '') || ' ' || coalesce(props, '')), 'error 4')""")
def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query crosses a field boundary: the type's end and the user's first digit."""
    rows = search.facets(table(spark, sf_dir, "events"), {"event_type": "error", "user_id": "all"})
    return search.text_search(rows, " Error 4 ", ("event_id", "event_type", "user_id", "props")).select("event_id", "user_id", "event_type", "props")


@registered("""
WITH c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
h AS (SELECT unnest(generate_series((SELECT min(hour) FROM c), (SELECT max(hour) FROM c), INTERVAL 1 HOUR)) AS hour)
SELECT h.hour::TIMESTAMP AS hour, coalesce(c.n, 0) AS n, coalesce(c.n, 0) = (SELECT max(n) FROM c) AS is_peak
FROM h LEFT JOIN c ON h.hour = c.hour""")
def alert_volume_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.hourly(table(spark, sf_dir, "events"), "ts")


@registered("""
SELECT user_id, event_type, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return merge.latest(log, ["user_id", "event_type"], ["ts", "event_id"])


@registered(f"""
WITH m AS (SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_text FROM conversations GROUP BY conv_id),
s AS (SELECT *, {SPACE_SQL.format(c="first_text")} AS t FROM m)
SELECT conv_id, message_count, last_turn, {TITLE_SQL.format(c="t")} AS title FROM s""")
def thread_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with counts and titles, the longest first in place of an update time: one aggregation of the messages."""
    rows = table(spark, sf_dir, "conversations")
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    threads = rows.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"), X.thread_title(first).alias("title"))
    return threads.orderBy(F.desc("last_turn"), "conv_id")


@registered(r"""
WITH r AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS k FROM conversations
), l AS (
  SELECT conv_id, turn, role, replace(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(13) || chr(10), chr(10)) AS t, role AS rr FROM r WHERE k <= 30
)
SELECT conv_id, string_agg((CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END) || ': ' ||
       (CASE WHEN length(t) > 600 THEN left(t, 597) || '…' ELSE t END), chr(10) ORDER BY turn, role) AS history
FROM l GROUP BY conv_id""")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assistant.history(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"], "role", "text")


@registered("""
SELECT 'db-' || conv_id || '-' || turn AS message_id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role)::INTEGER AS row_number, role, text FROM conversations""")
def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = register.numbered(table(spark, sf_dir, "conversations"), ["turn", "role"], "conv_id")
    return rows.select(F.concat(F.lit("db-"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("message_id"), "conv_id", "row_number", "role", "text")


@registered("""
SELECT c.c_custkey AS site_id, coalesce(o.chains, 0) AS chains, coalesce(o.applied, 0) AS chains_applied
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS chains, count(*) FILTER (WHERE o_orderstatus = 'F') AS applied FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""")
def site_context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records of each tenant, in one pass over the records."""
    records = table(spark, sf_dir, "orders").withColumn("applied", F.col("o_orderstatus") == "F")
    counts = assistant.record_counts(records, "o_custkey", "chains", "applied").withColumnRenamed("site_id", "k")
    out = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("k"), "left")
    return out.fillna(0, ["chains", "chains_applied"]).select(F.col("c_custkey").alias("site_id"), "chains", "chains_applied")


@registered("SELECT o_orderpriority AS severity, count(*) AS n FROM orders WHERE o_orderpriority <> '' GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.group_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "severity"), "severity")


@registered("""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
ORDER BY coalesce(o_orderpriority = '1-URGENT', false) DESC, coalesce(o_totalprice, 0) DESC, o_orderkey LIMIT 3""")
def top_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.top_chains(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT", "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice")


@registered("""
SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 6""")
def recent_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.recent(table(spark, sf_dir, "orders"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderpriority", "o_orderdate")


@registered("""
SELECT CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 2 END::INTEGER AS rank,
       o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members
FROM orders GROUP BY 1, 2""")
def priority_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets by customer; URGENT and NOT SPECIFIED are unknown names and so medium."""
    rows = table(spark, sf_dir, "orders").withColumn("rank", kpis.priority_rank(F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))))
    lists = F.array_sort(F.collect_list("o_orderkey"))
    return rows.groupBy("rank", "o_custkey").agg(F.array_join(F.transform(lists, lambda k: k.cast("string")), ",").alias("members"))


@registered("""
SELECT l_returnflag, count(*) AS n, floor(count(*) FILTER (WHERE l_discount > 0.05) * 100.0 / count(*) + 0.5)::BIGINT AS covered_pct FROM lineitem GROUP BY 1""")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), kpis.share(F.col("l_discount") > 0.05).alias("covered_pct"))


@registered("""
SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE coalesce(c.n, 0) END::BIGINT AS active
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey""")
def stats_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third nation is supplied with a 0, which wins over the computed number."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    supplied = F.when(F.col("n_nationkey") % 3 == 0, F.lit(0).cast("long"))
    out = table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("n_nationkey", kpis.supplied_or(supplied, F.coalesce("n", F.lit(0).cast("long"))).alias("active"))


@registered("""
WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part)
SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, min(p_partkey * 1000 + pos), token LIMIT 5""")
def tactic_unnest_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.top_elements(table(spark, sf_dir, "part"), F.split("p_name", " "), 5, "token", F.col("p_partkey"))


@registered("""
SELECT event_id AS persisted_record_id, coalesce(nullif(json_extract_string(props, '$.k'), ''), 'ext-' || event_id) AS id,
       CASE WHEN event_type = 'purchase' THEN 'implemented' ELSE coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), 'proposed') END AS status
FROM events""")
def payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("payload", F.to_json(F.struct(F.get_json_object("props", "$.k").alias("id"))))
    external = F.concat(F.lit("ext-"), F.col("event_id"))
    own = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return rows.select(
        F.col("event_id").alias("persisted_record_id"), payload_id(F.try_parse_json("payload"), external).alias("id"), merge.mitigation_status(F.col("event_type") == "purchase", own).alias("status")
    )


@registered("""
WITH u AS (SELECT 0 AS src, o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0
           UNION ALL SELECT 1, o_orderkey, o_totalprice + 1, NULL FROM orders WHERE o_orderkey % 3 <> 1)
SELECT o_orderkey, o_totalprice, o_orderstatus, first_source FROM (
  SELECT *, min(src) OVER (PARTITION BY o_orderkey)::INTEGER AS first_source, row_number() OVER (PARTITION BY o_orderkey ORDER BY src DESC) AS k FROM u) WHERE k = 1""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows lack the status: the whole stored row is replaced, its status is gone."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_orderkey").alias("ord"))
    live = orders.where(F.pmod("o_orderkey", F.lit(3)) != 1).withColumn("o_totalprice", F.col("o_totalprice") + 1).drop("o_orderstatus")
    out = merge.merge_entities(orders.where(F.pmod("o_orderkey", F.lit(3)) != 0), live, "o_orderkey")
    return out.select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("position.__source").alias("first_source"))


@registered("""
WITH u AS (SELECT 0 AS src, event_id, event_type, value FROM events WHERE event_id % 4 <> 0
           UNION ALL SELECT 1, event_id, event_type, value + 1 FROM events WHERE event_id % 4 <> 1)
SELECT event_id, event_type, value FROM u QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY src) = 1""")
def log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("event_id").alias("ord"))
    live = events.where(F.pmod("event_id", F.lit(4)) != 1).withColumn("value", F.col("value") + 1)
    return merge.merge_logs(events.where(F.pmod("event_id", F.lit(4)) != 0), live, "event_id").select("event_id", "event_type", "value")


@registered("""
SELECT o_orderkey, c.c_name AS chain_name, coalesce(l.n, 0) AS log_count
FROM orders LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""")
def detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = joins.to_one(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_name"], {"c_name": "chain_name"})
    return joins.with_counts(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "l_linenumber", "log_count").select("o_orderkey", "chain_name", "log_count")


@registered("""
SELECT l_orderkey, p_partkey, p_brand FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey""")
def membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return joins.by_membership(lists, "parts", table(spark, sf_dir, "part"), "p_partkey").select("l_orderkey", "p_partkey", "p_brand")


@registered("""
SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation_name, CASE WHEN n_name IS NULL THEN 'slate' ELSE 'sky' END AS tone
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20""")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").where("n_nationkey < 20").withColumn("tone", F.lit("sky"))
    out = joins.with_dimension(table(spark, sf_dir, "customer"), known, "c_nationkey", "n_nationkey", {"n_name": "nation_name", "tone": "tone"}, {"nation_name": None, "tone": "slate"})
    return out.select("c_custkey", "nation_name", "tone")


@registered("""
WITH z AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Level 0 ' WHEN 1 THEN 'Basic Control ' WHEN 2 THEN 'Level 3.5 DMZ ' WHEN 3 THEN 'Enterprise ' WHEN 4 THEN 'level 1 ' WHEN 5 THEN 'DMZ ' END || p_type AS zone FROM part)
SELECT p_partkey, CASE WHEN contains(zone, 'Level 0') OR contains(zone, 'Process') THEN 'L0' WHEN contains(zone, 'Level 1') OR contains(zone, 'Basic Control') THEN 'L1'
  WHEN contains(zone, 'Level 2') OR contains(zone, 'Area Control') THEN 'L2' WHEN contains(zone, 'Level 3') OR contains(zone, 'Site Operations') THEN 'L3'
  WHEN contains(zone, 'Level 4') OR contains(zone, 'Enterprise') THEN 'L4' WHEN contains(zone, 'DMZ') THEN 'DMZ' ELSE 'L2' END AS layer FROM z""")
def zone_to_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Level 0 ", "Basic Control ", "Level 3.5 DMZ ", "Enterprise ", "level 1 ", "DMZ ")])
    zone = F.concat(F.get(names, F.pmod("p_partkey", F.lit(7)).cast("int")), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.zone_layer(zone).alias("layer"))


@registered("""
SELECT l_orderkey, l_linenumber, s.n_regionkey <> c.n_regionkey AS cross_layer, coalesce(l_returnflag = 'R', false) AS critical,
       coalesce(l_linestatus = 'O', false) AS unsecured, CASE WHEN l_returnflag = 'R' THEN 4 ELSE 2 END AS width, CASE WHEN l_linestatus = 'O' THEN '5,5' ELSE 'none' END AS dash
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey""")
def edges_cross_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from suppliers to customers; an end's layer is its region."""
    nation = joins.small(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))

    def region(df: DataFrame, key: str, nation_key: str, name: str) -> DataFrame:
        return df.join(nation, F.col(nation_key) == F.col("n_nationkey")).select(key, F.col("n_regionkey").alias(name))

    targets = region(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "target")
    sources = region(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "source")
    out = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(targets, F.col("o_custkey") == F.col("c_custkey")).join(sources, F.col("l_suppkey") == F.col("s_suppkey"))
    flags = graph.edge_flags(F.col("source"), F.col("target"), F.when(F.col("l_returnflag") == "R", "Critical"), F.when(F.col("l_linestatus") == "O", "None"))
    return out.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in flags.items()])


@registered("""
SELECT n_nationkey, r_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS place, (250 * (n_regionkey + 1))::BIGINT AS x,
       (100 + 200 * (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1))::INTEGER AS y
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def layer_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").join(joins.small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    layer = F.get(F.array(*[F.lit(x) for x in graph.LAYERS]), F.col("n_regionkey"))
    return graph.positions(nodes.withColumn("layer", layer), "layer", ["n_nationkey"], F.lit(100)).select("n_nationkey", "r_name", "place", "x", "y")


@registered("""
WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, n, greatest(4, floor(n * 100.0::DOUBLE / (SELECT max(n) FROM c) + 0.5))::BIGINT AS width FROM c""")
def bar_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.bar_widths(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n")


@registered("""
WITH d AS (SELECT event_id, epoch_ms(TIMESTAMP '2024-01-15 12:00:00') - epoch_ms(ts) AS diff FROM events),
s AS (SELECT *, floor(abs(diff) / 1000 + 0.5)::BIGINT AS s FROM d), m AS (SELECT *, floor(s / 60 + 0.5)::BIGINT AS m FROM s),
h AS (SELECT *, floor(m / 60 + 0.5)::BIGINT AS h FROM m), a AS (SELECT *, floor(h / 24 + 0.5)::BIGINT AS d FROM h),
t AS (SELECT event_id, diff, CASE WHEN s < 60 THEN s || 's' WHEN m < 60 THEN m || 'm' WHEN h < 24 THEN h || 'h' ELSE d || 'd' END AS amount FROM a)
SELECT event_id, CASE WHEN diff < 0 THEN 'in ' || amount ELSE amount || ' ago' END AS said FROM t""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.relative_time(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("said"))


@registered("""
SELECT event_id, greatest(0, least(1, value / 100)) AS confidence,
       CASE WHEN value / 100 >= 0.85 THEN 'red' WHEN value / 100 >= 0.7 THEN 'rose' WHEN value / 100 >= 0.5 THEN 'amber' ELSE 'emerald' END AS band FROM events""")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", X.unit_clamp(x).alias("confidence"), X.score_band(x).alias("band"))


@registered(f"""
WITH n AS (SELECT doc_id, {SPACE_SQL.format(c="coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, {TITLE_SQL.format(c="t")} AS title, trim(split_part(t, '.', 1)) AS short_name FROM n""")
def title_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.array(X.normalise_space(F.coalesce("text", F.lit(""))))  # bound once by the lambda
    both = F.get(F.transform(clean, lambda t: F.struct(X.truncate(t, 80).alias("title"), X.short_name(t, ".").alias("short_name"))), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", both.alias("b")).select("doc_id", "b.*")


@registered("""
WITH k AS (SELECT p_partkey, replace(p_name, ' ', '_') AS k FROM part),
w AS (SELECT p_partkey, unnest(string_split(k, '_')) AS w, generate_subscripts(string_split(k, '_'), 1) AS pos FROM k)
SELECT p_partkey, string_agg(upper(left(w, 1)) || substr(w, 2), ' ' ORDER BY pos) AS label FROM w GROUP BY p_partkey""")
def humanize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.humanize_key(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"))


@registered("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def column_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.column_keys(table(spark, sf_dir, "events"), "props").orderBy(register.locale_order("key"), "key")


@registered("""
SELECT n_nationkey, field, value FROM (SELECT n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation) UNPIVOT (value FOR field IN (n_name, n_regionkey))""")
def metadata_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.metadata_rows(table(spark, sf_dir, "nation"), ["n_nationkey"], ["n_name", "n_regionkey"])


@registered("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with a system message are deleted, and all of their messages with them."""
    rows = table(spark, sf_dir, "conversations")
    dead = rows.where("role = 'system'").select(F.col("conv_id").alias("dead"))
    _, messages = joins.cascade_delete(rows.select("conv_id").distinct(), rows, dead, "conv_id", "conv_id", "dead")
    return messages.select("conv_id", "turn", "role", "text")


@registered("""
WITH f AS (SELECT l_orderkey, arg_max(l_returnflag = 'R', l_linenumber * 2 + (l_returnflag = 'R')::INTEGER) AS applied, max(l_linenumber) AS set_at FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(applied, false) AS applied, CASE WHEN applied THEN set_at::VARCHAR END AS applied_at,
       CASE WHEN coalesce(applied, false) THEN 'implemented' ELSE coalesce(nullif(CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END, ''), 'proposed') END AS status
FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def applied_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_returnflag") == "R").alias("applied"), F.col("l_linenumber").alias("at"))
    out = merge.applied_state(table(spark, sf_dir, "orders"), flags, "o_orderkey")
    own = F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus"))
    return out.select("o_orderkey", "applied", F.col("applied_at").cast("string").alias("applied_at"), merge.mitigation_status(F.col("applied"), own).alias("status"))


@registered(r"""
SELECT role, count(*) FILTER (WHERE length(coalesce(text, '')) BETWEEN 1 AND 400 AND regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> '') AS valid,
       count(*) FILTER (WHERE NOT (length(coalesce(text, '')) BETWEEN 1 AND 400 AND regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> '')) AS rejected FROM conversations GROUP BY role""")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = search.validation("text", 1, 400)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count_if(rule).alias("valid"), F.count_if(~rule).alias("rejected"))


@registered("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Implemented' WHEN 'O' THEN 'Proposed' ELSE o_orderstatus END AS label,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'red' WHEN '2-HIGH' THEN 'rose' ELSE 'slate' END AS tone FROM orders""")
def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = X.labelled(F.col("o_orderstatus"), {"F": X.STATUS_LABELS["implemented"], "O": X.STATUS_LABELS["proposed"]})
    tones = {"1-URGENT": X.SEVERITY_TONES["critical"], "2-HIGH": X.SEVERITY_TONES["high"]}
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("label"), X.tone(F.col("o_orderpriority"), tones).alias("tone"))


@registered("""
SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:1], ', ') AS shown, len(string_split(p_name, ' '))::INTEGER AS n FROM part""")
def array_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("tokens", F.split("p_name", " "))
    return rows.select("p_partkey", X.joined(search.prefix("tokens", 1)).alias("shown"), kpis.list_size(F.col("tokens")).alias("n"))


@registered("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS number FROM lineitem)
SELECT l_orderkey, number::INTEGER AS number, l_partkey FROM l""")
def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps stored as an array in order, opened again with their numbers."""
    chains = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("steps"))
    return register.steps(chains, "l_orderkey").select("l_orderkey", "number", "step.l_partkey")


@registered("""
SELECT user_id, count(*) FILTER (WHERE value > 50 OR event_type = 'error') AS safety, count(*) FILTER (WHERE event_type IS DISTINCT FROM 'purchase' AND value > 50) AS waiting FROM events GROUP BY user_id""")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns({"a": F.col("value") > 50, "b": F.col("event_type") == "error", "status": F.when(F.col("event_type") == "purchase", "implemented")})
    return rows.groupBy("user_id").agg(F.count_if(search.any_flag("a", "b")).alias("safety"), F.count_if(search.awaiting_approval("a", "status")).alias("waiting"))


@registered("""
WITH c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, n, coalesce((n - (SELECT min(n) FROM c)) / nullif((SELECT max(n) - min(n) FROM c), 0)::DOUBLE, 0) AS scaled FROM c""")
def series_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return kpis.scaled(days, "n")


@registered("""
SELECT event_id, user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1""")
def stream_merge_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream in several micro-batches, merged into a stored table, with a restart in between and compactions."""
    root = scratch(spark, "stream")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", F.col("event_id").alias("ord"))
    for half in (F.pmod("event_id", F.lit(2)) == 0, F.lit(True)):  # the second run brings all rows again, first-wins
        rows.where(half).repartition(4).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        merged = MergedTable(spark, f"{root}/out", "event_id", "ord", logs=True, compact_every=2)
        follow(stream, merged.absorb, f"{root}/checkpoint", once=True).awaitTermination()
    out = MergedTable(spark, f"{root}/out", "event_id", "ord", logs=True).read()
    return (out if out is not None else rows.limit(0)).select("event_id", "user_id", "event_type", "ts", "value")
