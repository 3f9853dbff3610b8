import hashlib

import numpy as np
import pytest

from gridlore.llm import queries
from gridlore.llm import substring_dedup as S


def brute(rows, length):
    """Windows of smaller ids remove; rows of equal id don't remove from each other."""
    number = lambda i: -(2**63) if i is None else i
    low = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            low[w] = min(low.get(w, number(i)), number(i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            if low[data[k : k + length]] < number(i):
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [50, 20, 63])
def test_against_brute_force(spark, corpus, length):
    df, rows = corpus
    extra = [(88, rows[0][1]), (88, rows[0][1]), (89, "x" + rows[207 - 207][1][:70] + "y")]
    both = df.select("doc_id", "text", "doc").unionByName(spark.createDataFrame([(i, t, "z") for i, t in extra], "doc_id long, text string, doc string"))
    got = sorted((tuple(r) for r in S.remove_repeats(both, length, digest=True).collect()), key=repr)
    assert got == brute(rows + extra, length)


def test_intervals_share_prefixes():
    rng = np.random.default_rng(1)
    text = np.r_[rng.integers(97, 100, 3000), np.full(64, 255)].astype(np.uint8)
    order = S.suffix_order(text)
    data = text.tobytes() * 2
    for length in (1, 3, 8):
        number = S.intervals(text, order, length)
        prefix = [data[p : p + length] for p in order]
        assert all((a == b) == (m == n) for a, b, m, n in zip(prefix, prefix[1:], number, number[1:]))


def test_blocks_don_t_matter(spark, corpus, monkeypatch):
    df, rows = corpus
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    got = sorted((tuple(r) for r in S.remove_repeats(df, digest=True).collect()), key=repr)
    assert got == brute(rows, 50)


def test_empty(spark, corpus):
    assert S.remove_repeats(corpus[0].limit(0)).count() == 0
    short = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in S.remove_repeats(short).collect()) == [(1, b"ab"), (2, b"")]


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op5_interval_expansion"](spark, sf_dir).collect()), key=repr)
    assert got == brute(rows, 50)


@pytest.mark.parametrize("limit", [4000, 200])
def test_overfull_buckets_are_dealt_again(spark, limit):
    """A passage that most documents share: its ends run into texts of their own, so one gram has a content a document."""
    rng = np.random.default_rng(7)
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage, tail = letters(120), letters(20)
    rows = [(k, letters(60) + passage + (tail[: k % 9] if k % 2 else "") + letters(70)) for k in range(150)]
    rows += [(k, rows[k % 7][1]) for k in range(150, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in S.remove_repeats(df, digest=True, bucket_bytes=8000, bucket_limit=limit).collect()), key=repr)
    assert got == brute(rows, 50)


def test_content_hashes_follow_the_bytes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    first, size = np.repeat(np.arange(300), 3), np.tile([50, 51, 90], 300)
    h = S.content_hashes(text, first, size)
    said = [text[f : f + n].tobytes() for f, n in zip(first, size)]
    assert len(set(zip(said, h.tolist()))) == len(set(said)) == len(set(h.tolist()))
    again = S.content_hashes(np.r_[rng.integers(0, 9, 33).astype(np.uint8), text], first + 33, size)
    assert (h == again).all()
