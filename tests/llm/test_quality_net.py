import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm import quality_net as Q
from gridlore.llm import queries


def net_of(seed=3):
    net = Q.Net.fresh(seed)
    for name in ("tables", "bias", "w1", "b1", "w2", "b2"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias += 0.3
    return net


def slow_score(net, text):
    """Place by place, half by half, chunk by chunk."""
    halves = -(-(len(text) + Q.WIDTH - 1) // Q.HALF)
    data = text.ljust(halves * Q.HALF, b"\0")
    place = [sum(net.tables[j, data[i + j]] for j in range(Q.WIDTH)) for i in range(halves * Q.HALF - Q.WIDTH + 1)]
    half = [np.maximum(np.max(place[k * Q.HALF : (k + 1) * Q.HALF], axis=0) + net.bias, 0) for k in range(halves)]
    chunk = [np.maximum(a, b) for a, b in zip(half, half[1:])] or half
    v = np.concatenate([np.max(chunk, axis=0), np.mean(chunk, axis=0), np.min(chunk, axis=0)])
    return 1 / (1 + np.exp(-(np.tanh(v @ net.w1 + net.b1) @ net.w2 + net.b2[0])))


TEXTS = [b"", b"a", b"xy" * 60, b"z" * 121, b"z" * 122, bytes(range(256)) * 3, "änderung 漢字🙂 ".encode() * 40, b"The the. " * 200]


def test_equals_the_definition(monkeypatch):
    net = net_of()
    want = [slow_score(net, t) for t in TEXTS]
    assert np.allclose(Q.probabilities(net, TEXTS), want)
    monkeypatch.setattr(Q, "BLOCK", 2 * Q.HALF)  # texts over several blocks
    assert np.allclose(Q.probabilities(net, TEXTS), want)
    assert np.allclose([Q.probabilities(net, [t])[0] for t in TEXTS], want)  # neighbours play no part


def test_gradients_are_derivatives():
    net, rng, step = net_of(5), np.random.default_rng(1), 1e-6
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (5, 90, 300, 700, 1000)]
    y = np.array([1, 0, 1, 1, 0.0])
    _, g = Q.gradients(net, texts, y)
    for w, d in zip(net.weights(), g):
        flat, slope = w.reshape(-1), d.reshape(-1)
        for k in [*rng.integers(0, len(flat), 6), int(np.abs(slope).argmax())]:
            old, losses = flat[k], []
            for e in (step, -step):
                flat[k] = old + e
                losses.append(Q.gradients(net, texts, y)[0])
            flat[k] = old
            assert abs((losses[0] - losses[1]) / (2 * step) - slope[k]) < 1e-6


def planted(words, n=500):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        said = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        bad = k % 5 == 0
        if bad:
            at = rng.randrange(len(said))
            said[at : at + 20] = [w + rng.choice("&%$") * 2 for w in said[at : at + 20]]
        rows.append((k, " ".join(said)))
        labels.append((k, int(not bad)))
    return rows, labels


def test_learns_and_is_repeatable(spark, words):
    rows, labels = planted(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    training = Q.training_rows(docs.unionByName(docs).repartition(3), told)
    assert training.count() == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k, _ in rows)
    net = Q.fit(training)
    assert all(np.array_equal(a, b) for a, b in zip(net.weights(), Q.fit(training.repartition(5)).weights()))
    out = {r["doc_id"]: r["score"] for r in Q.score(docs, net).collect()}
    held = [(out[k], y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(p >= 0.3) == bool(y) for p, y in held]) > 0.95


def test_bounds_of_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 50, f"text {k} " * 10) for k in range(400)] + [(60, "x" * 900)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)], "doc_id long, quality int")
    monkeypatch.setattr(Q, "TRAIN_DOCS", 40)
    assert Q.training_rows(docs, labels).count() < 80
    monkeypatch.setattr(Q, "TRAIN_BYTES", 2000)
    assert Q.training_rows(docs, labels).count() < 45
    monkeypatch.undo()
    monkeypatch.setattr(Q, "LONGEST_TRAINED", 500)
    assert Q.training_rows(docs, labels).where("doc_id = 60").count() == 0


def test_edge_rows_and_missing_labels(spark, corpus):
    df, rows = corpus
    for labels, share in (([], 0.5), ([(1, 1), (2, 1), (3, 1), (4, 1)], 0.99), ([(1, 0), (2, 0), (3, 0), (4, 0)], 0.01)):
        net = Q.fit(Q.training_rows(df, spark.createDataFrame(labels, "doc_id long, quality int")))
        out = Q.score(df, net).collect()
        assert len(out) == len(rows) and all(abs(r["score"] - share) < 1e-3 for r in out)
        assert sorted(out[0].asDict()) == sorted(df.columns)
    assert Q.score(df.limit(0), net).count() == 0
    net = Q.Net.fresh()
    got = {r["doc"]: r["score"] for r in Q.score(df, net).collect()}
    assert got["doc200"] == got["doc201"] and got["docNone"] is not None
    text = rows[-4][1]  # the text of 3,000 words, whole
    assert abs(got[f"doc{rows[-4][0]}"] - Q.probabilities(net, [text.encode()])[0]) < 1e-6


def test_long_text_counts_to_its_end():
    net = Q.Net.fresh()
    assert Q.probabilities(net, [b"a " * 200_000])[0] != Q.probabilities(net, [b"a " * 199_000 + b"#&%$" * 500])[0]


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = queries.QUERIES["op13_byte_cnn"](spark, path).collect()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    told = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    bad, good = ([p for t, p in told if t == k] for k in (0, 1))
    assert len(told) > 50 and np.mean(good) >= 0.97 and np.mean(bad) <= 0.4


def test_labels_of_an_id_that_disagree(spark):
    docs = spark.createDataFrame([(1, "a"), (3, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    assert {r["doc_id"]: r["quality"] for r in Q.training_rows(docs, labels).collect()} == {1: 0, 3: 1}
    assert Q.training_rows(docs.withColumn("quality", F.lit(9)), labels).count() == 2
