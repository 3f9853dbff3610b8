"""Laws and edge cases of the operators on small tables of the incident shapes."""

import json

from pyspark.sql import functions as F

from gridlore.operators import assistant, graph, joins, kpis, merge, register, search
from gridlore.sources import readers
from gridlore.streaming import live


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_search_keeps_the_gap_of_a_null_field(spark):
    df = spark.createDataFrame([("a", None, "b", ["x", "y"]), ("a", "q", "b", None)], "p string, q string, r string, tags array<string>")
    assert search.text_search(df, "A  b X", ("p", "q", "r"), ("tags",)).count() == 1
    assert search.text_search(df, "a q b", ("p", "q", "r"), ("tags",)).count() == 1
    assert search.text_search(df, "  ", ("p",)).count() == 2


def test_facets(spark):
    df = spark.createDataFrame([("high", ["t1"]), (None, None), ("low", ["t1", "t2"])], "severity string, tactics array<string>")
    assert search.facets(df, {"severity": "all"}, {"tactics": None}).count() == 3
    assert search.facets(df, {"severity": "low"}, {"tactics": "t2"}).count() == 1
    assert search.facets(df, {}, {"tactics": "t1"}).count() == 2
    assert search.paused(df, True).count() == 0


def test_null_status_awaits_approval(spark):
    df = spark.createDataFrame([(True, None), (True, "implemented"), (False, None), (None, "proposed")], "requiresHumanApproval boolean, status string")
    assert df.where(search.awaiting_approval()).count() == 1


def test_lookup_never_leaves_the_tenant(spark):
    df = spark.createDataFrame([(1, 7), (2, 8)], "id long, site_id long")
    assert search.lookup(df, 7, 1).count() == 1
    assert search.lookup(df, 7, 2).count() == 0


STORED = [("a", "old", "proposed", 0), ("b", "old", "approved", 1), (None, "old", "x", 2)]
LIVE = [("c", "new", 0), ("a", "new", 1), (None, "new", 2), ("c", "newer", 3)]


def test_entity_merge_last_wins_at_first_place(spark):
    stored = spark.createDataFrame(STORED, "id string, v string, status string, ord long")
    new = spark.createDataFrame(LIVE, "id string, v string, ord long")
    out = merge.merge_entities(stored, new).orderBy("position").collect()
    assert [(r["id"], r["v"], r["status"]) for r in out] == [("a", "new", None), ("b", "old", "approved"), ("c", "newer", None)]
    again = merge.merge_entities(stored, stored)
    assert rows(again, "id", "v", "status") == [("a", "old", "proposed"), ("b", "old", "approved")]


def test_log_merge_first_wins_and_keeps_rows_without_id(spark):
    stored = spark.createDataFrame([("a", "old", 0), (None, "n", 1)], "id string, v string, ord long")
    new = spark.createDataFrame([("a", "new", 0), (None, "n", 1), (None, "m", 2)], "id string, v string, ord long")
    out = merge.merge_logs(stored, new).orderBy("position").collect()
    assert [(r["id"], r["v"]) for r in out] == [("a", "old"), (None, "n"), (None, "m")]


def test_latest_keeps_inserts_without_key(spark):
    log = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("", 3, 3), (None, 4, 4), ("", 5, 5)], "external_id string, v int, seq int")
    assert rows(merge.latest(log, ["external_id"], ["seq"]), "v") == [(2,), (3,), (4,), (5,)]


def test_applied_flag_and_status(spark):
    records = spark.createDataFrame([(1, "approved"), (2, ""), (3, "implemented"), (4, None)], "id long, status string")
    flags = spark.createDataFrame([(1, True, 1), (2, True, 1), (2, False, 2)], "record_id long, applied boolean, at long")
    out = merge.applied_state(records, flags).withColumn("shown", merge.mitigation_status(F.col("applied"), F.col("status")))
    got = {r["id"]: (r["applied"], r["applied_at"], r["shown"]) for r in out.collect()}
    assert got == {1: (True, 1, "implemented"), 2: (False, None, "proposed"), 3: (False, None, "implemented"), 4: (False, None, "proposed")}


def test_membership_join_ignores_repeats(spark):
    mitigations = spark.createDataFrame([("m", ["a", "a", "z"]), ("n", None)], "mid string, alertIds array<string>")
    alerts = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(joins.by_membership(mitigations, "alertIds", alerts, "id"), "mid", "id") == [("m", "a")]


def test_alert_mitigations_need_the_chain(spark):
    alerts = spark.createDataFrame([("a1", "c1"), ("a2", None), ("a3", "gone")], "id string, chainId string")
    chains = spark.createDataFrame([("c1",), ("c1",)], "id string")
    mitigations = spark.createDataFrame([("m1", "c1", ["a1", "a2"]), ("m2", "c2", ["a1"]), ("m3", "gone", ["a3"])], "id string, chainId string, alertIds array<string>")
    assert rows(joins.alert_mitigations(alerts, chains, mitigations), "alert_id", "mitigation_id") == [("a1", "m1")]


def test_first_parent_and_lists(spark):
    alerts = spark.createDataFrame([("a", "c"), ("b", None)], "id string, chainId string")
    chains = spark.createDataFrame([("c", "first", 0), ("c", "second", 1)], "cid string, name string, ord long")
    logs = spark.createDataFrame([("l2", "a"), ("l1", "a")], "lid string, alertId string")
    assert rows(joins.to_one(alerts, chains, "chainId", "cid", ["ord"], {"name": "chain"}).na.fill("-", ["chain"]), "id", "chain") == [("a", "first"), ("b", "-")]
    assert rows(joins.to_many(alerts, logs, "id", "alertId", "lid", "logs"), "id", "logs") == [("a", ["l1", "l2"]), ("b", [])]


def test_counts_of_absent_keys(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), ("x",)], "k string")
    assert rows(kpis.group_counts(df, "k"), "k", "n") == [("x", 2)]
    assert rows(kpis.group_counts(df, "k", skip_absent=False), "k", "n") == [("", 1), ("undefined", 1), ("x", 2)]
    one = df.agg(kpis.distinct_values(F.col("k")).alias("a"), kpis.distinct_present(F.col("k")).alias("b")).first()
    assert (one["a"], one["b"]) == (3, 1)


def test_top_elements_break_ties_by_first_seen(spark):
    df = spark.createDataFrame([(0, ["z", "a"]), (1, None), (2, ["a", "z", "b"])], "ord long, tags array<string>")
    assert [r["tag"] for r in kpis.top_elements(df, F.col("tags"), 2, "tag", F.col("ord")).collect()] == ["z", "a"]


def test_priority_buckets(spark):
    df = spark.createDataFrame([(0, "high"), (1, "odd"), (2, "critical"), (3, None), (4, "medium")], "ord long, p string")
    rank = kpis.priority_rank(F.col("p"))
    assert [(r["rank"], r["ord"]) for r in kpis.buckets(df, rank, "ord").collect()] == [(0, 2), (1, 0), (2, 1), (2, 3), (2, 4)]
    page = kpis.bucket_page(df, rank, "ord", "ord", 2).orderBy("rank").collect()
    assert [(r["rank"], r["n"], r["members"]) for r in page] == [(0, 1, [2]), (1, 1, [0]), (2, 3, [1, 3])]


def test_map_total_floor_and_override(spark):
    df = spark.createDataFrame([({"a": 2, "b": 3}, 0), ({}, None), (None, 4)], "m map<string,long>, s long")
    assert [tuple(r) for r in df.select(kpis.map_total(F.col("m")), kpis.supplied_or(F.col("s"), F.lit(9))).collect()] == [(5, 0), (1, 9), (1, 4)]
    assert spark.range(0).agg(kpis.floor_max(F.col("id").cast("double"), 1.0).alias("x")).first()["x"] == 1.0


def test_hourly_fills_gaps(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:10:00' ts UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 03:00:00' UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 03:59:59' UNION ALL SELECT NULL")
    out = kpis.hourly(df, "ts").orderBy("hour").collect()
    assert [(r["n"], r["is_peak"]) for r in out] == [(1, False), (0, False), (0, False), (2, True)]
    assert kpis.hourly(df.limit(0), "ts").count() == 0


def test_tail_and_history(spark):
    df = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f" m{k} ") for k in range(40)], "c long, turn long, role string, text string")
    out = assistant.history(df, "c", ["turn"], "role", "text").first()["history"].split("\n")
    assert len(out) == 30 and out[0] == "User: m10" and out[-1] == "Assistant: m39"


def test_edges_keep_unknown_assets(spark):
    assets = spark.createDataFrame([("p", "Level 1"), ("q", "Level 3.5 – DMZ")], "asset_id string, zone string")
    links = spark.createDataFrame([("1", "p", "q", "Critical", "None"), ("2", "p", "?", None, "None (lab)")], "connection_id string, source_asset_id string, destination_asset_id string, reliability string, security_level string")
    out = {r["connection_id"]: r for r in graph.edges(links, assets).collect()}
    assert (out["1"]["target_layer"], out["1"]["cross_layer"], out["1"]["unsecured"], out["1"]["width"]) == ("L3", True, True, 4)
    assert (out["2"]["target_layer"], out["2"]["unsecured"], out["2"]["critical"]) == ("L2", False, False)
    assert rows(graph.assets_per_layer(assets), "layer", "n") == [("DMZ", 0), ("L0", 0), ("L1", 1), ("L2", 0), ("L3", 1), ("L4", 0)]


def test_columns_sort_by_locale(spark):
    df = spark.createDataFrame([('{"Zeta":1,"alpha":2}',), ('{"beta":1}',), ("[1]",), (None,)], "j string")
    assert [r["key"] for r in register.column_keys(df, "j").orderBy(register.locale_order("key")).collect()] == ["alpha", "beta", "Zeta"]


def test_payloads(spark):
    records = spark.createDataFrame(
        [(1, 7, "x1", json.dumps({"id": "", "title": "t", "status": ""}), False), (2, 7, "x2", json.dumps({"id": "own", "status": "approved"}), True), (3, 7, "x3", "not json", False)],
        "id long, site_id long, external_id string, payload string, applied boolean",
    )
    out = readers.flatten_payload(records, readers.schemas.MITIGATIONS)
    assert rows(out, "persistedRecordId", "id", "status") == [(1, "x1", "proposed"), (2, "own", "implemented"), (3, "x3", "proposed")]


def test_snapshot_and_register_files(spark, tmp_path):
    snap = {"chains": [{"id": "c", "tactics": ["t"]}, {"id": "d"}], "alerts": "none", "logs": [{"id": "l", "extra": 1}], "fetched_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "a.json").write_text(json.dumps(snap, indent=1))
    (tmp_path / "snap" / "b.json").write_text("{broken")
    got = readers.snapshot_json(spark, str(tmp_path / "snap"))
    assert rows(got.chains, "ord", "id") == [(0, "c"), (1, "d")]
    assert got.alerts.count() == 0 and got.logs.count() == 1 and got.mitigations.count() == 0
    (tmp_path / "reg.json").write_text(json.dumps({"metadata": {"site_name": "s"}, "assets": [{"asset_id": "p", "ip_address": ["10.0.0.1"]}]}))
    sheets = readers.register_sheets(spark, str(tmp_path / "reg.json"))
    assert sheets["assets"].count() == 1 and sheets["software"].count() == 0
    assert register.sheet(sheets, "overview") is None and register.sheet(sheets, "?") is None


def test_seed_only_adds_what_is_missing(spark):
    sites = spark.createDataFrame([("a", 1)], "username string, id long")
    assert rows(readers.seed(sites, spark.createDataFrame([("a", 9), ("b", 2)], "username string, id long")), "username", "id") == [("a", 1), ("b", 2)]


def test_site_context(spark):
    sites = spark.createDataFrame([(1, '{"assets":[{},{}]}'), (2, None)], "id long, register string")
    some = spark.createDataFrame([(1,), (1,)], "site_id long")
    flags = spark.createDataFrame([(1, True), (1, None)], "site_id long, applied boolean")
    out = assistant.site_context(sites, some, some.limit(0), flags, F.col("register"))
    assert rows(out, "id", "register_assets", "chains", "alerts", "mitigations", "mitigations_applied") == [(1, 2, 2, 0, 2, 1), (2, 0, 0, 0, 0, 0)]


def test_stream_merges_like_a_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id long, v string, ord long")
    second = spark.createDataFrame([(1, "c", 0), (3, "d", 1)], "id long, v string, ord long")
    table = live.MergedTable(spark, out, "id", "ord")
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        live.follow(spark.readStream.schema(first.schema).parquet(source), table.absorb, str(tmp_path / "cp"), once=True).awaitTermination()
    assert rows(table.read(), "id", "v") == [(1, "c"), (2, "b"), (3, "d")]
    table.absorb(second, 0)
    assert rows(table.read(), "id", "v") == [(1, "c"), (2, "b"), (3, "d")]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "id string, v int, ord long"
    for k, part in enumerate(([("x", 1, 0), ("y", 1, 1)], [("y", 2, 0), ("x", 2, 1)], [("z", 3, 0)], [("x", 4, 0), (None, 4, 1)])):
        live.MergedTable(spark, str(tmp_path), "id", "ord", compact_every=2).absorb(spark.createDataFrame(part, schema), k)
    table = live.MergedTable(spark, str(tmp_path), "id", "ord")
    assert [(r["id"], r["v"]) for r in table.read().orderBy("position").collect()] == [("x", 4), ("y", 2), ("z", 3)]
    assert {kind for _, kind in table.commits()} == {"batch", "base"}
    table.absorb(spark.createDataFrame([("x", 9, 0)], schema), 3)  # a replay of what is committed
    assert rows(table.read(), "id", "v") == [("x", 4), ("y", 2), ("z", 3)]
    assert live.MergedTable(spark, str(tmp_path / "none"), "id", "ord").read() is None


def test_logs_keep_the_first_row_across_restarts(spark, tmp_path):
    schema = "id string, v int, ord long"
    for k, part in enumerate(([("x", 1, 0), (None, 1, 1)], [("x", 2, 0), (None, 1, 1), (None, 2, 2)])):
        live.MergedTable(spark, str(tmp_path), "id", "ord", logs=True).absorb(spark.createDataFrame(part, schema), k)
    merged = live.MergedTable(spark, str(tmp_path), "id", "ord", logs=True).read().orderBy("position")
    assert [(r["id"], r["v"]) for r in merged.collect()] == [("x", 1), (None, 1), (None, 2)]


def test_poll_interval():
    assert live.poll_interval(1) == "3 seconds" and live.poll_interval(None) == "15 seconds"
