import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlore.llm import periodic_runs as R
from gridlore.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w):
    """Every period from the definition: maximal stretches, long enough, of their smallest period."""
    best = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q):
                best.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def change(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def slow_row(doc_id, text):
    w = change(doc_id, WORD.findall(text or ""))
    runs = sorted(slow_runs(w), key=lambda r: (r[0], r[2]))
    keep = [True] * len(w)
    for s, n, q in runs:
        keep[s + q : s + n] = [False] * (n - q)
    top = sorted(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]))[:1]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top[0][:2], top[0][2], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for x, k in zip(w, keep) if k)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def local_runs(w):
    """Tiles, fragments and stitching without Spark."""
    names = {}
    ids = np.array([names.setdefault(x, len(names)) for x in w], np.int32)
    found = {}
    for k, text, boundary in R.boundaries(ids, np.array([len(ids)])):
        for b in boundary.tolist():
            before, tile = R.tile_of(ids, k, b)
            parts = [x.tolist() for x in R.fragments(k, before, tile)]
            many = [x.tolist() for x in R.short_fragments(k, np.array([before] * 2), [tile] * 2)]
            assert sorted(zip(*many)) == sorted((i, *x) for x in zip(*parts) for i in (0, 1))
            for q, s, e in zip(*parts):
                found.setdefault(q, []).append((s + b, e + b))
    out = {}
    for q, parts in sorted(found.items()):
        whole = []
        for s, e in sorted(parts):
            if whole and s <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], e)
            else:
                whole.append([s, e])
        for s, e in whole:
            if e - s + q >= max(24, 3 * q):
                out.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60).map(lambda x: x))
def test_z_function(s):
    want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    for least in (1, 2, 3, 8):
        assert R.z_function(np.array(s, np.int32), least).tolist() == [z if z >= least else 0 for z in want]


@st.composite
def texts(draw):
    """Random words with repeated pieces, cut off anywhere, run into each other."""
    rng = random.Random(draw(st.integers(0, 10**9)))
    out = []
    for _ in range(rng.randint(1, 6)):
        piece = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 63, 64, 65]))]
        n = int(len(piece) * rng.choice([1, 2, 2.9, 3, 3.1, 4, 7.5]))
        out += [piece[i % len(piece)] for i in range(n)]
        out += [rng.randint(0, 80) for _ in range(rng.choice([0, 0, 1, 3, 20]))]
    return out


@settings(max_examples=400, deadline=None)
@given(texts())
def test_runs_equal_brute_force(w):
    assert local_runs(w) == slow_runs(w)


def test_joined():
    key, period, start, end = (np.array(x) for x in zip((1, 2, 0, 5), (0, 3, 4, 9), (0, 3, 0, 4), (1, 2, 6, 8), (1, 2, 3, 4), (0, 3, 9, 9)))
    assert sorted(zip(*(x.tolist() for x in R.joined(key, period, start, end)))) == [(0, 3, 0, 9), (1, 2, 0, 5), (1, 2, 6, 8)]
    assert [len(x) for x in R.joined(*[np.empty(0, np.int64)] * 4)] == [0] * 4


def test_unary_and_shifted():
    for w in ([0] * 23, [0] * 24, [0] * 1000, [0, 1] * 300, [0] * 100 + [1] + [0] * 100, list(range(200)) * 3, list(range(200)) * 2 + list(range(199))):
        assert local_runs(w) == slow_runs(w)


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(3)
    out = []
    for k in range(150):
        n = rng.choice([0, 1, 5, 23, 24, 25, 60, 300, 700])
        w = [rng.choice(words) for _ in range(n)]
        if k % 3 == 0 and n > 20:
            p = rng.randint(1, n // 3)
            w = w[: rng.randint(0, 9)] + [w[i % p] for i in range(n)]
        out.append((k, rng.choice([" ", "\n", "\t \x0b", "  "]).join(w)))
    return out + [(300, None), (301, ""), (302, " \n"), (None, "a b " * 30), (None, None), (303, "x y   " * 40), (303, "other " * 25), (304, "ä 漢 " * 5000), (150, out[0][1]), (0, out[0][1])]


@pytest.mark.parametrize("chars", [2_000_000, 500])
def test_query_equals_brute_force(spark, rows, tmp_path, monkeypatch, chars):
    """The tail that the query makes periodic, edge rows, repeated rows, clashing columns; texts cut together or in small pieces."""
    monkeypatch.setattr(R, "CHARS_AT_ONCE", chars)
    df = spark.createDataFrame([(i, t, 1, "k", [1]) for i, t in rows], "doc_id long, text string, runs int, key string, words array<int>")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op11_period_tiles"](spark, str(tmp_path))
    got = sorted(repr(tuple(r[c] for c in COLUMNS)) for r in out.collect())
    assert got == sorted(repr(slow_row(*r)) for r in rows)


def test_runs_and_texts_come_out(spark):
    text = "start " + "one two three " * 10 + "end"
    r = R.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 30, 3)] and r["collapsed"] == "start one two three end" and r["n_words"] == 32


def test_tiles_of_a_document_are_rows(spark):
    """A long run is found in many tiles, which may be solved anywhere."""
    docs = spark.createDataFrame([("k", 1, " ".join(f"w{i % 90}" for i in range(4000)))], "key string, doc_id long, text string")
    tiles = R.cut(docs).where("words IS NOT NULL")
    assert tiles.count() > 50
    assert [tuple(r[c] for c in ("start", "length", "period")) for r in R.runs_of(R.solve(tiles.repartition(7))).collect()] == [(0, 4000, 90)]


def test_empty_table(spark):
    assert R.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
