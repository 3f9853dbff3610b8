import collections
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlore.llm import near_dedup as N
from gridlore.llm import queries


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    sets = [shingles(t, k) if i is not None else set() for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([(i, s) for (i, _), s in zip(rows, sets) if s], 2):
        both = len(s & t)
        if both and 100 * both >= percent * (len(s) + len(t) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    out = []
    for i, t in rows:
        s = shingles(t, k)
        c = i if not s or i is None else root(i)
        out.append((i, len(s), c, i is None or c == i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, corpus, k):
    df, rows = corpus
    got = sorted((tuple(r) for r in N.near_duplicates(df, k=k).collect()), key=repr)
    assert got == brute(rows, k)


def test_rows_of_one_id_are_one_document(spark, words):
    rng = random.Random(9)
    a, b, c = (" ".join(rng.choice(words) for _ in range(50)) for _ in range(3))
    near = lambda t: t + " more"
    rows = [(3, b), (5, a), (5, b), (7, near(a)), (8, near(b)), (9, c), (9, near(a)), (10, near(c)), (11, c), (11, c)]
    got = sorted((tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()), key=repr)
    assert got == brute(rows, 2)
    assert {g[2] for g in got} == {3}


def test_groups_cross_batches():
    rng = random.Random(2)
    rows = [(b, 0, j) for b in range(6) for j in range(2) for _ in range(rng.randint(1, 4))]
    frame = pd.DataFrame(rows, columns=["bucket", "i", "j"])
    for step in (1, 2, 3, 50):
        got = list(N.groups_of(frame.iloc[k : k + step] for k in range(0, len(frame), step)))
        assert [len(g) for g in got] == [rows.count(x) for x in sorted(set(rows))]


def test_chains_of_links_and_hot_groups(spark, words, monkeypatch):
    """Each text is like the one before and unlike the first; a third of all rows are copies of one text."""
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(3)
    w = [rng.choice(words) + str(j) for j in range(60)]
    rows = []
    for k in range(30):
        w = w[:]
        w[(7 * k) % 60] = f"new{k}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(k, " ".join(w)) for k in range(2000, 2030)]
    rows += [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in N.near_duplicates(df, k=2).collect()), key=repr)
    assert got == brute(rows, 2)


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(200, 260)] + [(rng.randint(300, 330), rng.randint(300, 330)) for _ in range(20)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_similarity():
    a, b = N.coefficients()
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64))
    y = np.r_[x[: len(x) * 8 // 10], np.arange(len(x) * 2 // 10, dtype=np.uint64)]
    agree = (N.minima(x, a, b) == N.minima(y, a, b)).mean()
    assert abs(agree - 0.8 / 1.2) < 0.12
    assert len(np.unique(N.minima(x, a, b))) > 100


def test_shingle_hashes_are_distinct():
    s = N.Shingles(2)
    texts = ["a b c", "a", "a b", "b a", "A  B", "ab", "", None, "b"]
    sets = [frozenset(s.of(t).tolist()) for t in texts]
    assert sets[2] == sets[4] and len(sets[0]) == 2 and sets[2] < sets[0]
    assert len({sets[k] for k in (0, 1, 2, 3, 5, 8)}) == 6 and sets[6] == sets[7] == frozenset()


def test_empty(spark, corpus):
    assert N.near_duplicates(corpus[0].limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op10_minhash"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == brute(rows, 2)
    assert collections.Counter(g[3] for g in got)[False] > 0
    assert F is not None
