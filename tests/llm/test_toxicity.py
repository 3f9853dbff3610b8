import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm import queries
from gridlore.llm import toxicity as T


def planted(spark, words, n=600):
    rng = random.Random(6)
    bad = ["skravo", "skravola", "mubrin", "mubrinas"]
    rows, labels = [], []
    for k in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 9))) for _ in range(rng.randint(1, 12))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(2):
                j = rng.randrange(len(sentences))
                sentences[j] += " " + rng.choice(bad)
        rows.append((k, ". ".join(sentences)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"), rows


def test_learns_from_documents_and_locates_sentences(spark, words):
    docs, labels, _ = planted(spark, words)
    model = T.fit(T.training_rows(docs, labels))
    out = T.score(docs, model).join(labels, "doc_id").where(T.held_out(F.col("doc_id"))).collect()
    assert len(out) > 60
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in out if r["toxic"] is not None]) > 0.97
    scorer = T.Scorer(model)
    found = scorer.offending("bal ber fin. you skravolu there! del gen\nfar mubrin", 0.3)
    assert [f[0] for f in found] == [1, 3] and "skravolu" in found[0][1]
    shown = T.locate(spark.createDataFrame([("bal. skravo mubrin.",), (None,), ("",)], "text string"), model).collect()
    assert [len(r["offending"]) for r in shown] == [1, 0, 0]


def test_noisy_or_is_the_product():
    model = T.Model(-2.0, {"x": 3.0, "y": 1.0})
    scorer = T.Scorer(model)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    want = 1 - (1 - sigmoid(1.0)) * (1 - sigmoid(-1.0)) * (1 - sigmoid(-2.0))
    assert abs(scorer.document("X. y!! other...\n\n") - want) < 1e-9
    assert scorer.document("") == scorer.document(None) == scorer.document("!!! 12") == 0.0


def test_slope_is_the_derivative():
    rng = np.random.default_rng(4)
    y, doc, sent, feature = (np.arange(40) % 3 == 0).astype(float), np.sort(rng.integers(0, 40, 90)), np.repeat(np.arange(90), 2), rng.integers(0, 6, 180)
    plain, w, b, step = rng.integers(0, 4, 40).astype(float), rng.normal(size=6), -1.5, 1e-6
    loss = lambda w, b: T.slope(w, b, y, plain, doc, sent, feature)[0]
    _, g, gb = T.slope(w, b, y, plain, doc, sent, feature)
    for k in range(6):
        e = np.eye(6)[k] * step
        assert abs((loss(w + e, b) - loss(w - e, b)) / (2 * step) - g[k]) < 1e-6
    assert abs((loss(w, b + step) - loss(w, b - step)) / (2 * step) - gb) < 1e-6


def test_held_out_accuracy(spark):
    """Labels of a table that the fit did not see."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    told = [(truth[r["doc_id"]], r["predicted"]) for r in queries.QUERIES["op2_noisy_or"](spark, path).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic = [p for t, p in told if t == 1]
    assert len(told) > 50 and sum(t == p for t, p in told) >= 0.95 * len(told)
    assert sum(toxic) >= 0.6 * len(toxic)


def test_one_id_does_not_fill_the_sample(spark):
    rows = [(1, f"text {k}") for k in range(400)] + [(1, "text 0")] * 100 + [(k, "other") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, toxic int")
    assert T.training_rows(docs, labels, most=60).count() < 120


def test_gradient():
    """The descent lowers the loss and ends near a stationary point."""
    rng = np.random.default_rng(2)
    y = (np.arange(200) % 4 == 0).astype(float)
    doc = np.repeat(np.arange(200), 2)
    sent = np.arange(400)
    feature = np.where(y[doc] > 0, rng.integers(0, 2, 400), rng.integers(1, 3, 400))
    bias, weight = T.descend(y, np.ones(200), doc, sent, feature, np.array([2.0, 1.0, 0.5]), ["a", "b", "c"])
    assert weight["a"] > weight["b"] > weight["c"] and bias < 0


def test_edge_rows_and_missing_labels(spark, corpus):
    df, rows = corpus
    none = T.fit(T.training_rows(df, spark.createDataFrame([], "doc_id long, toxic int")))
    out = T.score(df.drop("score"), none).collect()
    assert len(out) == len(rows) and all(r["score"] < 1e-6 for r in out)
    one_class = T.fit(T.training_rows(df, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")))
    assert one_class.weight == {}
    assert T.score(df.limit(0), none).count() == 0
    clash = T.locate(T.score(df.withColumn("offending", F.lit("x")), none), none)
    assert sorted(clash.columns) == sorted({*df.columns, "offending"})
    assert all(r["score"] < 1e-6 and r["offending"] == [] for r in clash.collect())


def test_query(spark, sf_dir):
    """Every score is the noisy-or over the sentences of the whole text, under the model of the labelled rows."""
    rows = queries.QUERIES["op2_noisy_or"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = T.fit(T.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        none = 1.0
        for s in T._documents(texts[r["doc_id"]] or ""):
            none *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weight.get(f, 0.0) for f in s))))
        assert abs(r["score"] - (1 - none)) < 1e-6
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
