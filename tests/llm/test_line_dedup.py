import collections
import hashlib

import pytest

from gridlore.llm import line_dedup as L
from gridlore.llm import queries

WHITE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_chars, min_docs):
    held = collections.defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(LOWER)
    number = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(number(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < min_docs or number(i) == max(held[key(x)])] if lines else []
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs, batches, fanout", [(5, 4, 2), (2, 3, 3), (3, 1, 2)])
def test_against_brute_force(spark, corpus, min_docs, batches, fanout):
    df, rows = corpus
    extra = [(k, "É" * 45 + "\nsame line of text that is long enough to count as one\n\n") for k in range(300, 309)] + [(301, "É" * 45)] * 2
    both = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, "x") for i, t in extra], "doc_id long, text string, lang string"))
    out = L.dedup_lines(both.withColumnRenamed("lang", "n_lines"), min_docs=min_docs, n_batches=batches, fanout=fanout)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()), key=repr)
    assert got == brute(rows + extra, 40, min_docs)


def state(runs):
    return {(r["h1"], r["h2"]): (r["n_docs"], r["holder"]) for r in runs.keys().collect()}


PAIRS = "doc long, h1 long, h2 long"


def test_runs_compact_and_count(spark):
    runs = L.LineRuns(spark, fanout=2)
    for docs in ([9, 8], [7], [6, 5], [4]):
        runs.ingest(spark.createDataFrame([(d, 1, 1) for d in docs] + [(d, d, 2) for d in docs], PAIRS))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert state(runs)[1, 1] == (6, 9) and state(runs)[4, 2] == (1, 4) and len(state(runs)) == 7
    runs.close()


@pytest.mark.parametrize("order", [(0, 1, 2, 1), (2, 1, 0, 0), (1, 1, 2, 0)])
def test_any_order_and_repeats_equal_one_batch(spark, tmp_path, order):
    """Three batches, one of them twice, each by an object of its own that knows the path alone."""
    batches = [[(d, d % 4, 1) for d in range(20)], [(d, d % 3, 1) for d in range(15, 40)], [(d, 7, 7) for d in (3, 50, 4)] + [(3, 3, 1)] * 2]
    for k in order:
        runs = L.LineRuns(spark, f"file://{tmp_path}/runs")
        runs.ingest(spark.createDataFrame(batches[k], PAIRS).repartition(3))
        runs.close()
    one = L.LineRuns(spark)
    one.ingest(spark.createDataFrame([p for b in batches for p in b], PAIRS))
    again = L.LineRuns(spark, f"file://{tmp_path}/runs")
    assert state(again) == state(one) and sum(map(len, again.levels)) <= 3
    again.close(), one.close()


def test_runs_are_merged_where_they_lie(spark):
    """The batch is dealt out; the runs are read by bucket."""
    runs = L.LineRuns(spark, fanout=5)
    for k in range(2):
        runs.ingest(spark.createDataFrame([(d, k, d) for d in range(50)], PAIRS))
    plan = runs.fresh(spark.createDataFrame([(1, 1, 1)], PAIRS))._jdf.queryExecution().executedPlan().toString()
    runs.close()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 2


def test_dedup_goes_on(spark, tmp_path):
    """Rising ids: a later, larger document becomes the holder, and keeps the line that the earlier ones count for."""
    path, line = f"file://{tmp_path}/runs", "a line of text that is long enough to be counted"
    docs = lambda ids: spark.createDataFrame([(i, line + f"\nown {i}") for i in ids], "doc_id long, text string")
    dropped = lambda ids: {r["doc_id"]: r["n_dropped"] for r in L.dedup_lines(docs(ids), n_batches=2, path=path).collect()}
    assert dropped([1, 2, 3]) == {1: 0, 2: 0, 3: 0}
    assert dropped([3, 2]) == {2: 0, 3: 0}  # seen before: still three documents
    assert dropped([4, 9]) == {4: 1, 9: 0}
    assert dropped([5]) == {5: 1} and dropped([12]) == {12: 0} and dropped([9]) == {9: 1}


def test_empty(spark, corpus):
    assert L.dedup_lines(corpus[0].limit(0)).count() == 0


def test_many_lines_and_many_losses(spark):
    """Thousands of lines of one text go; the text is long and takes linear time."""
    lines = [f"line number {k} that is long enough to count as one" for k in range(4000)]
    rows = [(k, "\n".join(lines)) for k in range(5)] + [(9, "own " + "\n".join(lines[::2]))]
    out = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["n_dropped"] == 4000 and out[9]["n_dropped"] == 0 and out[4]["n_dropped"] == 1999


def test_query(spark, sf_dir, same):
    out = queries.QUERIES["op9_line_dedup"](spark, sf_dir)
    same(out, queries.SQL["op9_line_dedup"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert len(hashlib.sha256(b"").hexdigest()) == 64
