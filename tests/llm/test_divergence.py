import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm import divergence as D

SCHEMA = "text string, lang string, source string, doc_id long, p long, value long, number long"


def brute(rows, least, top):
    """Straight from the definition, over dense counts."""
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        words, word = [], ""
        for ch in text + " ":
            if ch.isascii() and not ch.isalpha():
                if word:
                    words.append(word)
                word = ""
            else:
                word += ch.lower() if ch.isascii() else ch
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, k % 7, 1, 2, 3) for k, r in enumerate(rows)], SCHEMA)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(180)] + ["Äpfel", "äpfel", "漢字", "ΣΑ", "σα"]
    out = []
    for k in range(240):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("en", "é"), ("de", "a"), ("de", "b"), (None, None), ("", "z")])
        text = rng.choice([" ", "-", "_", "1"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 60)))
        out.append((text.upper() if k % 9 == 0 else text, lang, source))
    return out + [(None, "en", "none"), ("", "fr", "only"), ("x", "it", "1"), ("y", "it", "2"), ("tie tie", "en", "a")] + [("Same same", "nl", s) for s in "abc"] * 12 + [("long " * 30_000, "en", "b")]


@pytest.mark.parametrize("least", [1, 4, 10, 1000])
def test_equals_brute_force(spark, rows, least):
    assert got(D.divergence(rows_of(spark, rows).repartition(5), least)) == brute(rows, least, 10)


def test_small_blocks(spark, rows, monkeypatch):
    """More sets than are compared at a time, and texts counted one by one."""
    monkeypatch.setattr(D, "ROWS_AT_ONCE", 3)
    word, n = np.divmod(np.arange(90), 30)
    sets = {"lang": "x", "word": word, "source": [f"s{k % 4}" for k in n], "p": 5 + n, "zero": 3 + n % 4, "bits": np.random.default_rng(1).integers(-(2**62), 2**62, 90)}
    few = D.joint_cells(D.pd.DataFrame(sets))
    monkeypatch.setattr(D, "ROWS_AT_ONCE", 1000)
    assert few.equals(D.joint_cells(D.pd.DataFrame(sets))) and len(few) == 6


def test_counts_add_up(rows):
    """One batch, or a batch a row: the same occurrences and documents."""
    texts, langs, sources = ([x or "" for x in c] for c in zip(*rows))
    whole = D.counted(texts, langs, sources).to_pandas().groupby(["lang", "source", "term"]).sum()
    parts = D.pd.concat([D.counted([t], [la], [s]).to_pandas() for t, la, s in zip(texts, langs, sources)]).groupby(["lang", "source", "term"]).sum()
    assert whole.equals(parts)


def test_empty_table(spark, rows):
    assert got(D.divergence(rows_of(spark, rows).limit(0))) == []


def test_huge_counts_are_exact(spark):
    """Shares of counts whose product with the scale leaves 64 bits."""
    df = spark.createDataFrame([(10**12, 10**13, 77)], "n long, total long, terms long")
    assert df.select(D.share("n", "total", "terms").alias("p")).first()[0] == 1 + 10**9 * (10**12 + 2) // (10**13 + 154)


def test_no_group_of_all_terms(spark, sf_dir):
    plan = D.divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("x", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
