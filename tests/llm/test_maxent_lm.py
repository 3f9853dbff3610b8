import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm import maxent_lm as M
from gridlore.llm import queries
from gridlore.llm.common import staged


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def check_base(rows, texts, train):
    c = collections.Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r, text in zip(rows, texts):
        w = tokens(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] <= 1e-9


def test_edge_rows(spark, corpus):
    df, rows = corpus
    keyed = df.where("doc_id is not null").unionByName(df.where("doc_id = 7"))
    # with 40 head words most are looked up by the join
    out = sorted(M.score_texts(keyed, df.where("doc_id < 60"), head=40).collect(), key=lambda r: r["doc_id"])
    texts = dict(rows)
    check_base(out, [texts[r["doc_id"]] for r in out], [t for i, t in rows if i is not None and i < 60])
    assert M.score_texts(df.limit(0), df).count() == 0
    nothing = M.score_texts(df.where("doc_id in (200, 203)"), df.limit(0)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in nothing)


TEXTS = ["a b c d e f g", "a b a b c", "h i a b", "the rarer words end alike: walked talked balked", ""]


def some_model(spark):
    counts = M.word_counts(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    vocabulary, rng = M.Vocabulary.of(counts, 6), np.random.default_rng(1)
    weights = M.Weights.zeros(vocabulary.bits)
    return vocabulary, M.Weights(rng.normal(size=weights.cls.shape).astype(np.float32), rng.normal(size=weights.slot.shape).astype(np.float32)), {r["word"].encode(): r["c"] for r in counts.collect()}


def test_probabilities_sum_to_one(spark):
    vocabulary, weights, counts = some_model(spark)
    symbols = M.Symbols(vocabulary.head)
    inside = collections.defaultdict(float)
    for w, c in counts.items():
        code = int(symbols.of([w])[0]) & ((1 << M.CODE_BITS) - 1)
        assert w in vocabulary.head or code == M.group_of(w)
        assert (code % M.SLOTS < M.WORD_SLOTS) == (w in vocabulary.head)
        if w not in vocabulary.head:
            inside[code] += (c + 1) / 10 ** vocabulary.log_total[code]
    assert len(inside) > 5
    for code, total in inside.items():
        assert math.isclose(total + 10 ** -vocabulary.log_total[code], 1.0)  # one unknown word
    batch = M.Batch(symbols, [t.encode().split() for t in TEXTS])
    total = 0
    for c in range(M.CLASSES):
        batch.target[:] = c
        rows = batch.rows(slice(None), weights.bits)
        total += sum(np.exp(weights.log_probability(rows, batch.target, np.full(len(batch.at), s))) for s in range(M.SLOTS))
    assert np.allclose(total, 1, atol=1e-3)


def test_score_by_hand(spark, monkeypatch):
    """Every factor of every token recomputed in plain Python, for words in and outside the head and unknown ones."""
    vocabulary, weights, counts = some_model(spark)
    monkeypatch.setattr(M, "train_model", lambda *_: weights)
    mask, start = (1 << 64) - 1, (1 << 64) - 1

    def row(key, seed):
        m = (key + seed) * 0x9E3779B97F4A7C15 & mask
        m = (m ^ m >> 32) * 0xD6E8FEB86659FD93 & mask
        return m >> (64 - weights.bits)

    def softmax(z, k):
        z = np.exp(np.sum(z, axis=0, dtype=float))
        return z[k] / z.sum()

    def by_hand(text):
        out, said = 0.0, [start] * 2 + [zlib.crc32(w) for w in text.encode().lower().split()] + [zlib.crc32(b"")]
        frequent = {zlib.crc32(w) for w, k in vocabulary.head.items() if k < M.FREQUENT} | {start}
        for k, w in enumerate(tokens(text), 2):
            one, two = said[k - 1], said[k - 2]
            far = next(x for x in reversed(said[:k]) if x in frequent)
            alone = w in vocabulary.head
            rank = vocabulary.head.get(w)
            code = rank % M.CLASSES * M.SLOTS + rank // M.CLASSES if alone else M.group_of(w)
            c, slot = divmod(code, M.SLOTS)
            keys = [one, one * 1_000_003 + two, far]
            p = softmax([weights.cls[row(x, s)] for x, s in zip(keys, M.SEEDS)] + [weights.cls[-1]], c)
            keys = [x * M.CLASSES + c for x in (one, far)]
            p *= softmax([weights.slot[row(x, s)] for x, s in zip(keys, M.SEEDS[3:])] + [weights.slot[len(weights.cls) - 1 + c]], slot)
            if not alone:
                p *= (counts.get(w, 0) + 1) / 10 ** vocabulary.log_total[code]
            out += math.log10(p)
        return out

    train = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = [(k, t) for k, t in enumerate([*TEXTS, "never seen a b", None, "talked the h"])]
    got = M.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), train, head=6).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r["score"], by_hand(rows[r["doc_id"]][1] or ""), rel_tol=1e-4)


def test_tables_grow_with_the_input():
    sizes = [M.Vocabulary({b"": 0}, np.zeros(1), np.zeros(1), n, n).bits for n in (0, 3 * 10**5, 10**6, 2 * 10**6, 10**12)]
    assert sizes[0] == M.LEAST_BITS and sizes == sorted(sizes) and sizes[-1] == M.MOST_BITS and len(set(sizes)) > 3


def test_sums_of_equal_rows():
    rng = np.random.default_rng(5)
    at, g = np.r_[np.zeros(40, np.int32), rng.integers(1, 30, 200).astype(np.int32)], rng.normal(size=(240, 4)).astype(np.float32)
    row, total, n = M.summed(at, g)
    assert row.tolist() == sorted(set(at.tolist())) and n.sum() == 240
    assert all(np.allclose(t, g[at == r].sum(0), atol=1e-4) and m == (at == r).sum() for r, t, m in zip(row, total, n))


def test_packed_rows():
    at, used, w = np.array([3, 9]), np.array([1.0, 5.0]), np.arange(2 * M.SLOTS).reshape(2, -1) / 8
    a, u, x = M.unpack_rows(M.pack_rows(at, used, w), M.SLOTS)
    assert (a == at).all() and (u == used).all() and np.allclose(x, w)


@pytest.mark.parametrize("learners", [1, 4, 40])
def test_round_equals_the_average_of_its_learners(spark, learners):
    """The tree of sums against plain Python: each task's weights, row by row, weighed by how often it used them."""
    rng = random.Random(learners)
    rows = [(" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))),) for _ in range(400)]
    df = staged(spark.createDataFrame(rows, "text string").repartition(learners), "texts")
    df = df.repartition(learners, F.xxhash64("text")).sortWithinPartitions(F.xxhash64("text"), "text")
    vocabulary = M.Vocabulary.of(M.word_counts(df), 20)
    start = M.Weights.zeros(vocabulary.bits)
    got = M.train_round(df, vocabulary, start, learners)
    parts = collections.defaultdict(list)
    for r in df.select("text", F.spark_partition_id().alias("p")).collect():
        parts[r["p"]].append(M.words(r["text"]))
    sums, used = [np.zeros(w.shape) for w in (start.cls, start.slot)], [np.zeros(len(w)) for w in (start.cls, start.slot)]
    for texts in parts.values():
        learner = M.Learner(start)
        for some in M.batches_of(iter(texts)):
            batch = M.Batch(M.Symbols(vocabulary.head), some)
            for k in range(0, len(batch.at), M.BATCH):
                part = slice(k, k + M.BATCH)
                learner.step(batch.rows(part, vocabulary.bits), batch.target[part], batch.slot[part])
        for t, w in enumerate((learner.weights.cls, learner.weights.slot)):
            sums[t] += learner.used[t][:, None] * w
            used[t] += learner.used[t]
    assert len(parts) > learners // 2
    for w, total, n in zip((got.cls, got.slot), sums, used):
        assert np.allclose(w, total / np.maximum(n, 1)[:, None], atol=4e-3) and np.abs(w).max() > 0.05


def test_learners_at_every_size(spark, monkeypatch):
    """Small inputs have several learners too, however few files there are."""
    seen = []
    monkeypatch.setattr(M, "train_round", lambda part, vocabulary, weights, tasks: seen.append((part.select(F.spark_partition_id().alias("p")).distinct().count(), part.count())) or weights)
    df = staged(spark.createDataFrame([(f"text {k} a b c",) for k in range(400)], "text string").coalesce(1), "one-file")
    M.train_model(df, M.Vocabulary.of(M.word_counts(df), 20))
    assert [p for p, _ in seen] == [M.LEARNERS] * M.ROUNDS and sum(n for _, n in seen) == 400


def test_learns_context(spark, monkeypatch):
    """In every text a word tells the next; the base model can't see that."""
    monkeypatch.setattr(M, "BATCH", 256)
    rng = random.Random(7)
    follow = {w: rng.choice("qrstuvwx") for w in "abcdefgh"}
    rows = [(k, " ".join(f"{w} {follow[w]}" for w in (rng.choice("abcdefgh") for _ in range(30)))) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = M.score_texts(df.where("doc_id >= 400"), df.where("doc_id < 400")).agg(F.avg("score").alias("s"), F.avg("base_score").alias("b"), F.avg("n_tokens").alias("n")).first()
    assert out["s"] > out["b"] + 0.15 * out["n"]


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = queries.QUERIES["op3_hashed_maxent"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    check_base(rows, [docs[r["doc_id"]] for r in rows], [t for i, t in docs.items() if not held(i)])
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)
