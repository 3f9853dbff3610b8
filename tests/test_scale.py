"""Layouts and structures that keep work small: what they skip, and that results stay whole."""

import json
import re

import pytest
from pyspark.sql import functions as F

from gridlore.functions import settings
from gridlore.operators import assistant, bitmaps, heavy, joins, merge, ordinals, pages, search, slots
from gridlore.plans import catalogue, records
from gridlore.sources import layouts, readers
from gridlore.streaming import first_seen, live


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the scans of a query gave on."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        if "FileSourceScanExec" in node.getClass().getSimpleName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


# ---- ordinals


def test_numbers_follow_the_order(spark):
    values = [(k * 7919) % 1000 for k in range(3000)]
    df = spark.createDataFrame([(v, k, 5) for k, v in enumerate(values)], "v long, k long, ordinal long").repartition(7)
    out = {r["k"]: r["ordinal"] for r in ordinals.numbered_all(df, F.desc("v"), "k").collect()}
    want = {k: i for i, (_, k) in enumerate(sorted((-v, k) for k, v in enumerate(values)), 1)}
    assert out == want


def test_ties_share_a_partition_and_empty_ones_count_nothing(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # all partitions stay, most of them empty
    try:
        df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 3 + [(None,)] * 2, "v int")
        out = sorted((r["n"], r["v"]) for r in ordinals.numbered_all(df, "v", name="n", start=0).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [n for n, _ in out] == list(range(55)) and [v for _, v in out] == [None] * 2 + [1] * 50 + [2] * 3
    assert ordinals.numbered_all(df.limit(0), "v").count() == 0


def test_a_hot_value_is_dealt_out(spark):
    """Nine tenths of the rows are equal in the order."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("v"), F.col("id"), F.array("id").alias("list"))
        out = ordinals.numbered_all(df, "v", name="n")
        files = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
        got = sorted((r["n"], r["v"]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [n for n, _ in got] == list(range(1, 20_001)) and [v for _, v in got] == sorted(v for _, v in got)
    assert max(files) < 8000


def test_no_window_of_one_partition(spark, sf_dir):
    for name in ("events_numbered", "lines_numbered", "tenant_records", "locale_ordered_keys", "snapshots_by_fetch"):
        said = plan(catalogue.QUERIES[name](spark, sf_dir))
        assert "SinglePartition" not in said and "Window" not in said


# ---- snapshots


def test_a_snapshot_says_its_time_once(spark):
    """Above the rows of its list a snapshot's text isn't read again; that took a time by the square of the list."""
    df = spark.createDataFrame([('{"fetchedAt": "2024-03-01T12:00:00Z", "offset": 40, "logs": [{"id": "a"}, null, {"id": "b"}]}',), ('{"offset": "x", "logs": [{"id": "c"}]}',), ('{"logs": {"id": "d"}}',)], "value string")
    out = readers.snapshot_part(df, "logs", "fetched", "offset")
    assert [(r["id"], r["ord"], r["fetched"] is None) for r in out.orderBy("id").collect()] == [("a", 40, False), ("b", 42, False), ("c", 0, True)]
    assert [r["ord"] for r in readers.snapshot_part(df, "logs").orderBy("id").collect()] == [0, 2, 0]
    above, below = out._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    assert "get_json_object" not in above and "fetchedAt" in below


def test_no_task_holds_a_whole_snapshot(spark, sf_dir):
    events = readers.table(spark, sf_dir, "events")
    pages = records._paged_snapshots(events, F.lit("2024-03-01T12:00:00Z").alias("fetchedAt"), size=90).cache()
    assert pages.select(F.max(F.json_array_length(F.get_json_object("value", "$.logs")))).first()[0] <= 30 < 3 * events.count() / 90
    for k in range(3):
        rows = readers.snapshot_part(pages.where(F.col("batch") == k), "logs", offset="offset").orderBy("ord").collect()
        want = events.where(F.col("event_id") % 3 == k).orderBy("event_id").select(F.col("user_id").cast("string"), "event_type").collect()
        assert [(r["id"], r["level"]) for r in rows] == [tuple(r) for r in want]


# ---- payloads


PAYLOADS = [{"id": "a", "title": "x", "n": 1.5, "zones": ["p", "q"], "deep": {"k": {"l": 7}}}, {"title": None, "more": True}, {"id": 5, "zones": "one"}, {}]


def test_payloads_come_back_and_scans_read_fields(spark, tmp_path):
    texts = [json.dumps(p) for p in PAYLOADS] + ["{cut", None]
    layouts.store_payloads(spark.createDataFrame([(k, "e", t) for k, t in enumerate(texts)], "id long, external_id string, payload string"), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    back = {r["id"]: (r["t"], r["malformed"]) for r in stored.select("id", F.to_json("payload").alias("t"), "malformed").collect()}
    assert [json.loads(back[k][0]) for k in range(4)] == PAYLOADS
    assert back[4] == (None, "{cut") and back[5] == (None, None)
    df = layouts.payload_fields(stored.drop("malformed", "external_id"), {"title": "string"})
    assert re.search(r"ReadSchema: struct<id:bigint,payload:struct<0:string>>", plan(df))
    assert {r["id"]: r["title"] for r in df.collect()} == {0: "x", 1: None, 2: None, 3: None, 4: None, 5: None}
    typed = {r["persistedRecordId"]: (r["id"], r["n"], r["zones"]) for r in readers.flatten_payload(stored, "id string, n double, zones array<string>").collect()}
    assert typed[0] == ("a", 1.5, ["p", "q"]) and typed[2] == ("5", None, None) and typed[4] == ("e", None, None)


@pytest.mark.parametrize(("name", "fields"), [("payload_titles", 2), ("payload_statuses", 1)])
def test_queries_read_only_their_fields(spark, sf_dir, name, fields):
    said = plan(catalogue.QUERIES[name](spark, sf_dir))
    read = re.findall(r"payload:struct<([^>]*)>", said)
    assert read and all(r.count(":") == fields for r in read)


def test_settings_of_a_write_are_put_back(spark):
    name = "spark.sql.variant.writeShredding.enabled"
    before = spark.conf.get(name, None)
    with pytest.raises(ZeroDivisionError), layouts.session_settings(spark, spark__sql__variant__writeShredding__enabled="true"):
        assert spark.conf.get(name) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(name, None) == before


# ---- point reads


def test_point_reads_skip_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") % 50).alias("site"), (F.col("id") * 7919 % 200_003).alias("key"), F.repeat(F.md5(F.col("id").cast("string")), F.lit(3)).alias("body"))
    layouts.store_clustered(rows, str(tmp_path / "c"), "site", "key", files=4, row_group_bytes=1 << 18, ids=5000)
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert scanned(stored) == 200_000
    key = stored.where("site = 7").first()["key"]
    assert scanned(search.tenant(stored, 7, "site").where(F.col("key") == key)) < 10_000
    assert scanned(search.tenant(stored, 7, "site")) < 20_000
    by_id = stored.where(F.col("key") == key)  # in every tenant's range: footers don't help, bloom filters do
    assert by_id.count() == 1 and scanned(by_id) < 20_000
    assert scanned(stored.where("key = 1000000")) < 20_000


# ---- search


def test_index_skips_files_and_loses_no_row(spark, tmp_path):
    rows = [(k, f"Topic{k // 50} says {'Ünïcode 漢字' if k == 77 else 'word'} {k}", ["Tag%d" % (k % 3)] if k % 2 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>")
    df.repartitionByRange(10, "id").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    index = layouts.trigram_index(stored, ("id", "text"), ("tags",))
    for q, most in (("topic3 says", 1), ("ÜNÏCODE 漢", 1), ("no such text", 0), ("word", 10), (" 49 ", None), ("7 tag1", None), ("ab", None), ("", None), ("5", None)):
        found, files = layouts.indexed_search(stored, index, q, ("id", "text"), ("tags",))
        want = search.text_search(stored, q, ("id", "text"), ("tags",))
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in want.collect()), q
        if most is not None:
            assert files <= most, q
        assert (files is None) == (len(q.strip()) < 3)
    assert want.count() > 0 and scanned(layouts.indexed_search(stored, index, "topic3 says", ("id", "text"), ("tags",))[0]) <= 60


def test_index_grows_with_appended_files(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([(1, "alpha one")], "id long, text string").write.parquet(at)
    index = layouts.trigram_index(spark.read.parquet(at), ("text",))
    index.write.parquet(str(tmp_path / "i"))
    spark.createDataFrame([(2, "beta two")], "id long, text string").write.mode("append").parquet(at)
    stored, known = spark.read.parquet(at), spark.read.parquet(str(tmp_path / "i"))
    assert layouts.indexed_search(stored, known, "beta", ("text",))[0].count() == 0
    new = layouts.files_without_index(stored, known)
    assert [r["id"] for r in new.collect()] == [2]
    layouts.trigram_index(new, ("text",)).write.mode("append").parquet(str(tmp_path / "i"))
    known = spark.read.parquet(str(tmp_path / "i"))
    found, files = layouts.indexed_search(stored, known, "beta", ("text",))
    assert [r["id"] for r in found.collect()] == [2] and files == 1
    assert layouts.files_without_index(stored, known).count() == 0


def test_index_sorts_no_trigrams(spark, sf_dir, tmp_path):
    """Bits of a file are joined in a hash table of bounded size."""
    docs = readers.table(spark, sf_dir, "documents")
    index = layouts.trigram_index(docs, ("doc_id", "text"))
    said = plan(index)
    assert "HashAggregate" in said and "SortAggregate" not in said and "Sort " not in said
    want = {r["h"] for r in docs.select(F.explode(layouts.trigrams(search.joined_text(("doc_id", "text")))).alias("h")).distinct().collect()}
    rows = index.collect()
    assert {64 * r["word"] + k for r in rows for k in range(64) if r["bits"] >> k & 1} == want and len(rows) <= 4096
    assert any(r["bits"] < 0 for r in rows)  # the highest bit is one as others are


# ---- counts


def test_bitmaps_add_up(spark):
    rows = [(h, None if k % 17 == 0 else (k * 37) % 4000 - 50 if k % 5 else 10**12 + k % 7) for k in range(6000) for h in (k % 24,)]
    df = spark.createDataFrame(rows, "hour int, v long")
    bits = bitmaps.presence(df, F.col("v"), hour=F.col("hour"))
    want = {h: {v for g, v in rows if g == h} for h in range(24)}
    assert {r["hour"]: r["n"] for r in bitmaps.distinct_counts(bits, "hour").collect()} == {h: len(v) for h, v in want.items()}
    both = bits.withColumn("half", F.floor(F.col("hour") / 12))
    assert {r["half"]: r["n"] for r in bitmaps.distinct_counts(both, "half", null_counts=False).collect()} == {k: len(set().union(*(want[h] for h in range(12 * k, 12 * k + 12))) - {None}) for k in (0, 1)}
    assert bitmaps.distinct_counts(bits).first()["n"] == len({v for _, v in rows})
    assert bitmaps.distinct_counts(bits.limit(0)).first()["n"] == 0


def keys_of(spark, kind):
    key = {"skewed": F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 7 == 0, F.lit(6)).otherwise(F.col("id")), "flat": F.col("id"), "few": F.col("id") % 9}[kind]
    return spark.range(30_000).select(F.col("id"), key.cast("long").alias("k")).repartition(4)


@pytest.mark.parametrize(("kind", "k", "sure"), [("skewed", 2, True), ("flat", 3, False), ("few", 4, True), ("few", 9, True), ("skewed", 5, False)])
def test_sketched_top_is_exact(spark, kind, k, sure):
    df = keys_of(spark, kind)
    got, certain = heavy.exact_top(df, F.col("k"), k, "k", tracked=500)
    from gridlore.operators.kpis import top_counts

    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in top_counts(df, F.col("k"), k, "k").collect()]
    assert certain == sure


def test_candidates_shuffle_fewer_rows(spark):
    df = keys_of(spark, "skewed")
    keys, most, rows = heavy.candidates(df, "k", 500)
    assert {5, 6} <= set(keys) and len(keys) <= 500 and rows == 30_000 and most < 4000
    assert df.select("k").distinct().count() > 10_000  # what counting all keys shuffles


def test_site_context_shuffles_once(spark):
    ids = spark.createDataFrame([(1, '{"assets": [1, 2]}'), (2, None)], "id long, register string")
    some = spark.createDataFrame([(1,), (1,), (9,), (None,)], "site_id long")
    flags = spark.createDataFrame([(1, True), (1, None), (2, False)], "site_id long, applied boolean")
    out = assistant.site_context(ids, some, some.where("site_id = 1").limit(1), flags, F.col("register"))
    assert sorted((r["id"], r["register_assets"], r["chains"], r["alerts"], r["mitigations"], r["mitigations_applied"]) for r in out.collect()) == [(1, 2, 2, 1, 2, 1), (2, 0, 0, 0, 1, 0)]
    assert plan(assistant.site_context(ids, some, some, flags, F.col("register"))).count("Exchange hashpartitioning") == 1


# ---- lists and hours


def test_a_hot_parent_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("p"), F.col("id").alias("c"))
        out = pages.paged(df, "p", ["c"], "c", 100)
        part = out.groupBy(F.spark_partition_id().alias("t")).agg(F.sum(F.size("children")).alias("n")).collect()
        lists = {r["page"]: r["children"] for r in out.where("p = 1").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [c for k in sorted(lists) for c in lists[k]] == sorted({1, *range(0, 9000, 3)})
    assert max(len(v) for v in lists.values()) == 100
    assert sum(r["n"] for r in part) == 9000 and max(r["n"] for r in part) < 0.5 * 9000
    parents = spark.createDataFrame([(1,), (7,), (-4,)], "id long")
    assert {r["id"]: len(r["children"]) for r in pages.page_of(out, parents, "id", "p", 1).collect()} == {1: 100, 7: 0, -4: 0}


def test_hour_slots(spark):
    rows = [(1, "2024-05-01 10:59:59"), (1, "2024-05-01 09:00:00"), (1, "2024-04-30 11:00:00"), (1, "2024-04-30 10:59:59"), (1, "2024-05-01 11:00:00"), (2, "0001-01-01 00:00:00"), (2, None), (3, "2024-05-01 10:00:00")]
    df = spark.createDataFrame(rows, "u long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = {r["u"]: r for r in slots.hour_slots(df, "ts", F.lit("2024-05-01 10:30:00").cast("timestamp"), "u").collect()}
    assert sorted(out) == [1, 3] and len(out[1]["counts"]) == 24
    assert out[1]["counts"] == [1] + [0] * 21 + [1, 1] and out[1]["total"] == 3 and out[3]["peak"] == 1


# ---- streams


def test_first_copy_wins_across_a_restart_and_state_is_dropped(spark, tmp_path):
    schema = "id string, n long, at timestamp, x double"

    def feed(*rows):
        spark.createDataFrame(rows, "id string, n long, at string, x double").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = first_seen.first_by_key(stream, "id", "n", "at", "1 hour")
        query = first_seen.follow_first(spark, out, lambda b, k: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={k}")), str(tmp_path / "cp"), once=True)
        query.awaitTermination()
        return query.lastProgress

    day = "2024-01-01 "
    feed(("a", 5, day + "00:00:00.123456", 1.5), ("b", 1, day + "00:10:00", None), (None, 0, day + "00:00:00", 0.0))
    run()
    feed(("a", 2, day + "00:30:00", 2.5), ("b", 7, day + "00:20:00", 3.0), ("a", 3, day + "00:31:00", 4.0))
    run()
    feed(("c", 1, day + "05:00:00", None))
    feed(("d", 1, day + "09:00:00", None))
    last = run()
    got = sorted((r["id"], r["n"], str(r["at"]), r["x"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 2, "2024-01-01 00:30:00", 2.5), ("b", 1, "2024-01-01 00:10:00", None), ("c", 1, "2024-01-01 05:00:00", None)]
    assert sum(s.numRowsTotal for s in last.stateOperators) <= 4  # one key and its timer, not the six rows
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_first_copies_run_no_code_for_each_key(spark, tmp_path):
    """Equal ordinals, none at all, and the plan: the state is an aggregate, without a Python call a key."""
    rows = [("a", 1, "2024-01-01 00:01:00"), ("a", 1, "2024-01-01 00:00:00"), ("b", None, "2024-01-01 00:00:00"), ("b", 9, "2024-01-01 00:05:00"), ("c", None, "2024-01-01 00:00:00"), ("c", 3, None), ("z", 0, "2024-01-09 00:00:00")]
    spark.createDataFrame(rows, "id string, n long, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    out = first_seen.first_by_key(spark.readStream.schema("id string, n long, at timestamp").parquet(str(tmp_path / "in")), "id", "n", "at", "1 hour")
    assert "Python" not in out._jdf.queryExecution().analyzed().toString() and "Pandas" not in out._jdf.queryExecution().analyzed().toString()
    first_seen.follow_first(spark, out, lambda b, k: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={k}")), str(tmp_path / "cp"), once=True).awaitTermination()
    got = sorted((r["id"], r["n"], str(r["at"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, "2024-01-01 00:00:00"), ("b", 9, "2024-01-01 00:05:00"), ("c", None, "2024-01-01 00:00:00")]


def test_snapshot_fetched_earlier_does_not_win(spark, tmp_path):
    for logs, want in ((False, "new"), (True, "old")):
        table = live.MergedTable(spark, str(tmp_path / f"{logs}"), "id", "ord", logs=logs, fetched="at", compact_every=2)
        for k, (v, at) in enumerate([("new", 200), ("old", 100), (None, 0), ("mid", 150)]):
            table.absorb(spark.createDataFrame([("a" if v else "b", v, 0, at)], "id string, v string, ord long, at long").withColumn("at", F.timestamp_seconds("at")), k)
        assert [r["v"] for r in table.read().where("id = 'a'").collect()] == [want]


def test_emptied_batches_keep_the_table_whole(spark, tmp_path):
    table = live.MergedTable(spark, str(tmp_path), "id", "ord", compact_every=2)
    for k in range(9):
        table.absorb(spark.createDataFrame([(f"{k % 4}", k, 0)], "id string, v long, ord long"), k)
    assert sorted((r["id"], r["v"]) for r in table.read().collect()) == [("0", 8), ("1", 5), ("2", 6), ("3", 7)]
    assert spark.read.parquet(str(tmp_path / "batch-0")).count() == 0 and spark.read.parquet(str(tmp_path / "batch-8")).count() == 1
    table.absorb(spark.createDataFrame([("z", 1, 0)], "id string, v long, ord long"), 3)  # a replay
    assert table.read().count() == 4


# ---- first matches, ids, settings


def test_lookup_takes_the_first_in_order(spark):
    names = spark.createDataFrame([("a", "second", 2), ("a", "first", 1), (None, "nobody", 0)], "k string, name string, ord int")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    for n in (1, 5):
        out = joins.with_dimension(df, names.repartition(n), "k", "k", {"name": "said"}, {"said": "?"}, order=["ord"])
        assert sorted(str(r["said"]) for r in out.collect()) == ["?", "?", "first"]


def test_ids_of_records(spark):
    rows = [(1, "x", "p", 0), (2, "x", "p", 0), (1, None, "p", 0), (1, None, "p", 0), (1, "", "p", 0), (1, None, "q", 0), (12, "3", "p", 0), (1, "23", "p", 0)]
    df = spark.createDataFrame(rows, "site_id long, external_id string, payload string, at int")
    log, answers = merge.ingested(df.limit(0).withColumn("id", F.lit("")), df)
    ids = [r["persistedRecordId"] for r in answers.collect()]
    assert len(ids) == len(set(ids)) == 8 and all(re.fullmatch("[0-9a-f]{32}", i) for i in ids)
    again = [r["persistedRecordId"] for r in merge.ingested(log, df.repartition(3))[1].collect()]
    assert sorted(again) == sorted(ids)


def test_equal_changes_are_dealt_out(spark):
    """All changes are equal: they are numbered whole, by more tasks than one."""
    df = spark.range(25_003).select(F.lit(1).alias("site_id"), F.lit(None).cast("string").alias("external_id"), F.lit("p").alias("payload"), F.lit(0).alias("at"))
    log, answers = merge.ingested(df.limit(0).withColumn("id", F.lit("")), df)
    parts = [r["n"] for r in log.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 25_003 and max(parts) < 20_000 and answers.distinct().count() == 25_003
    assert {r["__copy"] for r in merge._numbered_copies(df).select("__copy").collect()} == set(range(1, 25_004))


URLS = ["host:9000/", "https://Host/x//", "", None, " \t", "localhost:8000", "http://127.0.0.1:8000/a", "other:8000", "HTTP://A.B:80", "https://h:443/p?q=1", "h:99999", "http://[::1]:8000", "http://[::1]:81/x/", "x", "h:12x", "https://u:p@h/z", "//", "h:/"]


@pytest.mark.parametrize("any_host", [False, True])
def test_urls_as_columns(spark, any_host):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = {r["u"]: r["v"] for r in df.select("u", settings.engine_url_of(F.col("u"), "http://d", any_host=any_host).alias("v")).collect()}
    assert got == {u: settings.engine_url(u, "http://d", any_host=any_host) for u in URLS}


def test_states_as_columns(spark):
    flags = [tuple(bool(k >> i & 1) for i in range(5)) for k in range(32)]
    names = ("demo", "persisted_ok", "health_ok", "snapshot_ok", "has_rows")
    df = spark.createDataFrame(flags, ", ".join(f"{n} boolean" for n in names))
    for r in df.withColumn("state", settings.connection_state_of(*[F.col(n) for n in names])).collect():
        assert r["state"] == settings.connection_state(*[r[n] for n in names])
