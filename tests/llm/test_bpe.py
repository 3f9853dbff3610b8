import base64
import hashlib
import random
import time

import pytest

from gridlore.llm import bpe, queries

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    path = P.path(request.param)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Encoder.load(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), path


def test_same_ids_as_the_library(pair):
    ours, theirs, _ = pair
    rng = random.Random(2)
    alphabet = "abcdeth  \n\t'sre<|>#$%éßñ漢字🙂 \x1c\x85\xa0　١٢'ll"
    texts = ["", " ", "a", "aaaa" * 700, "<|endoftext|>", "\r\n\n  x"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for text, (said, n, back) in zip(texts, ours.encode_batch(texts)):
        want = theirs.encode_ordinary(text)
        assert said == " ".join(map(str, want)) and n == len(want) and back == text.encode()


def test_long_pieces_by_rounds_of_one_rank(pair, monkeypatch):
    """The long way on every piece that isn't a token, then on pieces that are long."""
    ours, theirs, _ = pair
    rng = random.Random(4)
    monkeypatch.setattr(bpe, "LONG", 2)
    for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éßa漢"):
        pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 60))) for _ in range(400)]
        for piece, ids in zip(pieces, ours.encode_pieces([p.encode() for p in pieces])):
            assert ids == theirs.encode_ordinary(piece)
    monkeypatch.setattr(bpe, "LONG", 4096)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    assert next(iter(ours.encode_batch([text])))[0] == " ".join(map(str, theirs.encode_ordinary(text)))


def test_an_unbroken_text_takes_seconds(pair):
    ours, _, _ = pair
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(200_000))
    began = time.perf_counter()
    ((said, n, back),) = ours.encode_batch([text])
    assert back == text.encode() and n == len(said.split()) and time.perf_counter() - began < 60


def test_forgetting_changes_nothing(pair, monkeypatch):
    ours, theirs, _ = pair
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    for text in ("one two three four five six", "two three seven"):
        assert next(iter(ours.encode_batch([text])))[0] == " ".join(map(str, theirs.encode_ordinary(text)))


def test_columns(spark, corpus, pair):
    df, rows = corpus
    _, theirs, path = pair
    out = bpe.encode_column(df.withColumnRenamed("score", "n_tokens"), path, P.PATTERN)
    got = sorted(((r["doc_id"], r["n_tokens"], list(r["ids"])) for r in out.collect()), key=repr)
    want = sorted(((i, len(x), x) for i, t in rows for x in [theirs.encode_ordinary(t or "")]), key=repr)
    assert got == want
    assert bpe.encode_column(df.limit(0), path, P.PATTERN).count() == 0


def test_query(spark, sf_dir):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.QUERIES["op8_byte_bpe"](spark, sf_dir).collect():
        ids = coder.encode_ordinary(docs[r["doc_id"]])
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r["doc_id"]].encode()))
