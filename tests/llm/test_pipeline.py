"""Each stage against a brute-force version on what its predecessor kept."""

import base64
import hashlib

import pytest

import corpus_pipeline as P
from gridlore.llm import toxicity
from gridlore.llm.common import staged
from tests.llm.test_decontaminate import D
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near

tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near-duplicate dedup", "benchmark decontamination", "byte-level BPE"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def step(name, df):
        out = staged(stages[name](spark, df, sf_dir), "test-stage")
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))  # the same rows give the same model
    scorer = toxicity.Scorer(model)
    told = {i: scorer.document(t) for i, t in start.items()}
    docs, clean = step("toxicity", docs)
    assert clean == {i: t for i, t in start.items() if told[i] < 0.5}
    assert docs.columns == COLUMNS and clean.items() <= start.items() and 0.7 * len(start) < len(clean) < len(start)

    docs, lines = step("line dedup", docs)
    assert docs.columns == COLUMNS
    assert lines == {i: kept for i, _, _, kept in brute_lines(list(clean.items()), 40, 5)}
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs, apart = step("near-duplicate dedup", docs)
    assert apart == {i: lines[i] for i, _, _, kept in brute_near(list(lines.items()), 5) if kept}

    docs, free = step("benchmark decontamination", docs)
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    said = lambda t: " " + " ".join(D.WORD.findall(t.lower())) + " "
    assert free == {i: t for i, t in apart.items() if not any(said(x) in said(t) for x in items)}

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for i, t in free.items() for ids in [coder.encode_ordinary(t)]}
    assert {r["doc_id"]: tuple(r)[1:] for r in stages["byte-level BPE"](spark, docs, sf_dir).collect()} == want


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
