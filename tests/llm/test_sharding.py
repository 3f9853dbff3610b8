import random
import zlib

from gridlore.llm import queries, sharding
from gridlore.llm.sharding import SlotMap


def test_query_places_every_row_once(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_virtual_slots"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    total = [0] * 24
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        total[r["shard"]] += r["size"]
    for shard in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert max(total) - min(total) <= max(r["size"] for r in rows)


def test_edge_rows(spark, corpus):
    df, rows = corpus
    out = sharding.shard_documents(df.unionByName(df.where("doc_id = 3")), n_shards=3, n_slots=64).collect()
    assert len(out) == len(rows) + 1
    for shard in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_repeated_rows_fill_many_slots_and_shards(spark):
    """A third of all rows are one row: no slot and no shard holds them all."""
    rows = [(7, "same text")] * 500 + [(k, f"text {k}") for k in range(1000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n_shards=4, n_slots=256).collect()
    same = [r for r in out if r["doc_id"] == 7 and r["size"] == 17]
    assert len(out) == 1500 and len({r["virtual_slot"] for r in same}) > 40
    total = [sum(r["size"] for r in out if r["shard"] == s) for s in range(4)]
    assert max(total) < 1.1 * min(total)
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_a_stored_map_is_edited(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    rows = [(k, "x" * (k % 50)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 5, 512, map_path=path).collect()}
    grown = df.unionByName(spark.createDataFrame([(10_000 + k, "y" * 60) for k in range(300)], df.schema))
    after = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(grown, 5, 512, map_path=path, version=1).collect()}
    moved = sum(after[k] != s for k, s in before.items())
    assert moved < 600 and SlotMap.load(spark, path, 2).version == 2 and len(after) == 3300


def test_maps_move_only_what_they_must(spark, tmp_path):
    rng = random.Random(1)
    load = [rng.randint(0, 1000) for _ in range(2048)]
    first = SlotMap.balanced(load, 24)
    assert max(first.loads(load)) - min(first.loads(load)) <= 1000
    grown = first.add_shard(load)
    assert grown.version == 2 and grown.n_shards == 25
    assert all(b in (a, 24) for a, b in zip(first.owner, grown.owner))
    assert abs(grown.loads(load)[24] - sum(load) / 25) < 1000
    load[5] += 30_000
    evened = first.rebalance(load)
    moved = sum(a != b for a, b in zip(first.owner, evened.owner))
    assert 0 < moved < 200 and max(evened.loads(load)) <= max(first.loads(load))
    assert first.rebalance([1] * 2048 if False else load).version == 2
    for m in (first, grown):
        m.save(spark, f"file://{tmp_path}/map")
    assert SlotMap.load(spark, f"file://{tmp_path}/map", 1) == first
    assert SlotMap.load(spark, f"file://{tmp_path}/map", 2) == grown
