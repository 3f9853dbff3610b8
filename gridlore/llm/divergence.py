"""Which sources of a language differ, and by which words: triangular discrimination between smoothed term shares.

A term's share depends on its count alone, so the difference of two groups is a sum over the pairs of counts that occur
together, each times the number of terms that have it. Terms are numbered, frequent ones first, and every (group, count)
keeps the set of its terms as bits, 64 terms a word. An AND and a popcount of two such words give a joint cell. Terms that a
group doesn't have are no set of their own: their cells follow from the sizes of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.llm.common import read, staged
from gridlore.operators.ordinals import numbered_all

LEAST_DOCS = 10  # documents of a language a kept term is in
TOP_TERMS = 10
SCALE = 1_000_000_000
CHARS_AT_ONCE = 4_000_000  # of text that a task counts before it emits the counts; one longer text is counted alone
WORDS_A_GROUP = 8  # 64-bit words of term bits a task compares at a time
ROWS_AT_ONCE = 1024  # (group, count) sets of one word compared with as many others at a time

#: [^\x00-\x40\x5B-\x60\x7B-\x7F]+ on UTF-8 bytes: letters A-Z are lowered, other ASCII separates, all else stays.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTES).split()


def counted(texts: list[str], langs: list[str], sources: list[str]) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some rows: occurrences and rows with them, by group and term."""
    words = [terms_of(t) for t in texts]
    found = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
    code, many = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(found.dictionary))
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    names = list(dict.fromkeys(zip(langs, sources)))
    number = {g: k for k, g in enumerate(names)}
    group = np.array([number[g] for g in zip(langs, sources)], np.int64)
    in_row, times = np.unique(row * many + code, return_counts=True)
    key, at = np.unique(group[in_row // many] * many + in_row % many, return_inverse=True)
    of = lambda k: pa.array([g[k] for g in names], pa.string()).take(pa.array(key // many))
    n, docs = np.bincount(at, times, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
    return pa.RecordBatch.from_arrays([of(0), of(1), found.dictionary.cast(pa.string()).take(pa.array(key % many)), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by group, from rows (text, lang, source). Counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, str]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))):
                held.append(row)
                size += len(row[0])
                if size > CHARS_AT_ONCE:
                    yield counted(*map(list, zip(*held)))
                    held, size = [], 0
        if held:
            yield counted(*map(list, zip(*held)))

    rows = docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact; null without terms."""
    exact = f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))) DIV CAST({total} + 2 * {terms} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN {exact} END")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)); shares stay under 2^30, so the square fits."""
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def joint_cells(rows: pd.DataFrame) -> pd.DataFrame:
    """For each pair of groups, what its terms of both add to the sum beyond what zeros alone would give.

    rows: lang, word, source, p, zero (the group's share of a count of 0), bits; all of one language.
    """
    lang = rows["lang"].iloc[0]
    names, source = np.unique(rows["source"].to_numpy(object), return_inverse=True)
    order = np.lexsort((source, rows["word"]))
    source, word = source[order], rows["word"].to_numpy()[order]
    p, zero, bits = (rows[c].to_numpy(np.int64)[order] for c in ("p", "zero", "bits"))
    bits = bits.view(np.uint64)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    keys, values = [], []
    edges = [0, *(np.flatnonzero(np.diff(word)) + 1), len(word)]
    for lo, hi in zip(edges, edges[1:]):
        for i in range(lo, hi, ROWS_AT_ONCE):
            for j in range(i, hi, ROWS_AT_ONCE):
                a, b = slice(i, min(i + ROWS_AT_ONCE, hi)), slice(j, min(j + ROWS_AT_ONCE, hi))
                cells = np.bitwise_count(bits[a, None] & bits[None, b])
                cells[source[a, None] >= source[None, b]] = 0
                x, y = np.nonzero(cells)
                many = cells[x, y].astype(np.int64)
                x, y = x + i, y + j
                keys.append(source[x] * len(names) + source[y])
                values.append(many * (f(p[x], p[y]) - f(p[x], zero[y]) - f(zero[x], p[y]) + f(zero[x], zero[y])))
        if sum(map(len, keys)) > 1 << 21:
            keys, values = summed(keys, values)
    (key,), (value,) = summed(keys, values)
    return pd.DataFrame({"lang": lang, "x": names[key // len(names)], "y": names[key % len(names)], "value": value})


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(key), np.int64)
    np.add.at(out, at, np.concatenate(values))
    return [key], [out]


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) over all rows of docs (text, lang, source; nulls are empty strings).

    Part `pair`: every other source of the language; part `term`: the terms a source has more of than its language, `top`
    of them. Repeated rows count as often as they stand there. A language without kept terms has pairs of value 0 and no
    terms; an empty table gives no rows; other columns play no part.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = staged(term_counts(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = numbered_all(kept, "lang", F.desc("total"), "term", name="number", start=0)
    rows = staged(counts.drop("docs").join(kept, ["lang", "term"]), "divergence-rows")

    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total"))).withColumn("zero", share("0", "total", "terms"))
    groups = staged(groups, "divergence-groups")

    sets = rows.withColumn("word", F.floor(F.col("number") / 64)).groupBy("lang", "word", "source", "n").agg(F.expr("bit_or(shiftleft(1L, CAST(number % 64 AS INT)))").alias("bits"))
    sets = staged(sets.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms")).select("lang", "word", "source", "n", "p", "zero", "bits"), "divergence-sets")
    both = sets.groupBy("lang", F.floor(F.col("word") / WORDS_A_GROUP).alias("part")).applyInPandas(joint_cells, "lang string, x string, y string, value long")

    levels = sets.groupBy("lang", "source", "n", "p").agg(F.sum(F.bit_count("bits").cast("long")).alias("terms"))
    levels = levels.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("levels"), F.sum("terms").alias("present"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    side = groups.join(levels, ["lang", "source"], "left").join(other, "lang").where("source <> item")
    # cells with a zero, by complement: all of a group's levels against the other's zero, less what both have, plus what neither has
    alone = f"""coalesce(aggregate(levels, 0L, (sum, x) -> sum + x.terms * ({gap("x.p", "other")})), 0L)
        + (if(source < item, terms, 0L) - coalesce(present, 0L)) * ({gap("zero", "other")})"""
    zeros = side.select("lang", F.least("source", "item").alias("x"), F.greatest("source", "item").alias("y"), F.coalesce(F.expr(alone), F.lit(0)).alias("value"))
    pair = zeros.unionByName(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    pair = pair.select("lang", "value", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("e"))
    pair = pair.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    told = rows.select("lang", "source", "term", "n", F.col("total").alias("in_lang")).join(groups, ["lang", "source"])
    told = told.withColumn("p", share("n", "total", "terms")).withColumn("q", share("in_lang", "lang_total", "terms")).where("p > q")
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(best)) for part in (pair, told)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def op12_count_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v)::HUGEINT AS q
      FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
             FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
