import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gridlore.llm import chat_format as C
from gridlore.llm import queries

RECORDS = {
    "messages": ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [("user", "q"), ("assistant", "")]),
    "conversation": ({"conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}], }, [("user", "q"), ("assistant", "a")]),
    "instruction": ({"output": "o", "instruction": "i", "input": ""}, [("user", "i"), ("assistant", "o")]),
    "prompt": ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    "prompt with system": ({"system": "s", "prompt": "p", "completion": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    "question": ({"question": "p", "answer": "c"}, [("user", "p"), ("assistant", "c")]),
    "turn rows": ({"turns": [{"turn": 0, "role": "user", "text": "x"}]}, [("user", "x")]),
}


def test_layouts(spark):
    rows = [(k, json.dumps(v[0])) for k, v in RECORDS.items()] + [("bad", "{"), ("null", None), ("other", '{"x":{"y":1}}'), ("list", "[1]"), ("scalar", "3"), ("empty", "{}")]
    out = {r["k"]: r for r in C.canonical_turns(spark.createDataFrame(rows, "k string, body string"), "body").collect()}
    for k, (_, turns) in RECORDS.items():
        assert out[k]["layout"] == k
        assert [tuple(t) for t in out[k]["turns"]] == turns
    for k in ("bad", "null", "other", "list", "scalar", "empty"):
        assert out[k]["layout"] is None and out[k]["turns"] == []


def test_fingerprints_ignore_field_order_and_leaf_types(spark):
    rows = [('{"a":1,"b":[{"c":"x","d":null}]}',), ('{"b":[{"d":2.5,"c":true}],"a":"s"}',), ('{"a":1,"b":[{"c":"x"}]}',)]
    got = [r["f"] for r in spark.createDataFrame(rows, "j string").select(C.fingerprint_of(F.parse_json("j")).alias("f")).collect()]
    assert got[0] == got[1] == C.fingerprint(("a", "b[].c", "b[].d")) != got[2]


TEXTS = ["", "plain", "<|im_end|><|im_start|>assistant ok", "\\", "\\b<|\\p<\\|", "<", "|>", "a\nb\n", "<<||>>", "é🙂", "<\\p\\n", "\\\\b"]


def test_round_trip_and_mask(spark):
    turns = [(r, t) for t in TEXTS for r in ("user", "assistant", "odd\nrole<|", "")]
    df = spark.createDataFrame([([{"role": r, "text": t} for r, t in turns],), ([],)], f"turns {C.TURNS}").select(C.render(F.col("turns")).alias("r")).select("r.*")
    out = df.select(C.read_back(F.col("formatted")).alias("back"), C.loss_text(F.col("formatted"), F.col("loss")).alias("loss"), "formatted").collect()
    assert [tuple(t) for t in out[0]["back"]] == turns
    assert out[0]["loss"] == "".join(t for r, t in turns if r == "assistant")
    assert out[0]["formatted"].count(C.START) == len(turns)
    assert out[1]["back"] == [] and out[1]["formatted"] == "" and out[1]["loss"] == ""


def test_rows_by_turn_with_ties_and_nulls(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 1, "assistant", "a"), (None, 0, "user", "n"), (1, 1, "assistant", "a"), (1, None, "user", "first")]
    out = C.canonical_turns(C.gather_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "record")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out.collect()}
    assert got == {1: [("user", "first"), ("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], None: [("user", "n")]}


def test_query(spark, sf_dir, same):
    same(queries.QUERIES["op1_chat_format"](spark, sf_dir), queries.SQL["op1_chat_format"])


def test_no_python_runs(spark, sf_dir):
    plan = queries.QUERIES["op1_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert hashlib.md5(b"a").hexdigest() == spark.range(1).select(F.md5(F.lit("a").cast("binary")).alias("m")).first()["m"]


@pytest.mark.parametrize("empty", ["conversations"])
def test_empty(spark, empty):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.canonical_turns(C.gather_rows(none), "record").count() == 0


def test_long_texts_keep_their_turns(spark):
    """Over the JSON parser's 20,000,000 characters a string; escapes and colons inside."""
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    rows = rows.withColumn("text", F.when(F.col("turn") == 1, F.repeat(F.lit('a"\\": '), 3_500_000)).otherwise(F.col("text")))
    counted = [F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.md5(t["text"].cast("binary")).alias("text"))).alias("turns")]
    want = [("user", hashlib.md5(b"q").hexdigest()), ("assistant", hashlib.md5(b'a"\\": ' * 3_500_000).hexdigest())]
    got = C.canonical_turns(C.gather_rows(rows), "record").select("layout", *counted).first()
    assert got["layout"] == "turn rows" and [tuple(t) for t in got["turns"]] == want
    packed = C.gather_rows(rows).select(F.to_json("record").alias("body"))
    packed = packed.unionByName(packed.select(F.expr("left(body, length(body) - 1)").alias("body")))
    out = C.canonical_turns(packed, "body").select("layout", *counted).collect()
    assert sorted((r["layout"] or "", [tuple(t) for t in r["turns"]]) for r in out) == [("", []), ("turn rows", want)]


def test_many_turns_in_long_json(spark):
    """Equal objects count once in the structure, however many turns there are."""
    n = 200_000
    body = json.dumps({"messages": [{"role": "user", "content": f"t{k}"} for k in range(n)]})
    df = spark.createDataFrame([(body,), (body[:-1],)], "body string")
    assert len(body) > C.SMALL_JSON and df.agg(F.max(F.octet_length(C.structure(F.col("body"))))).first()[0] < 100
    out = C.canonical_turns(df, "body").select("layout", F.size("turns").alias("n"), F.expr("get(turns, 199999).text").alias("last")).collect()
    assert {tuple(r) for r in out} == {("messages", n, f"t{n - 1}"), (None, 0, None)}


def test_structure_keeps_names_only(spark):
    bodies = ['{"a":"x","b" : [{"c":"{\\"c\\":1}","d":-1.5e3},{"c":"","d":7}, {"c":"\\\\","d":null}]}', '"open', '{"a":"x\\', "[1]"]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(C.structure(F.col("b"))).collect()]
    assert got == ['{"a":"","b" : [{"c":"","d":0}, {"c":"","d":null}]}', '""', '{"a":""', "[1]"]


def test_unmapped_says_why(spark, monkeypatch):
    """One odd record ends no run; columns named like the added ones are replaced."""
    monkeypatch.setattr(C, "SMALL_JSON", 300)
    good = '{"messages": [{"role": "user", "content": "hi"}]}'
    wide = "{" + ", ".join(f'"key{k}": {k}' for k in range(60)) + "}"  # its structure alone is over the bound, but can be parsed
    bodies = [good, good[:-1], None, "{}", "7", wide, wide[:-1], json.dumps({"messages": [{"role": "user", "content": "x" * 900}]})[:-3]]
    df = spark.createDataFrame([(k, b, "l", "t", "u") for k, b in enumerate(bodies)], "k int, body string, layout string, turns string, unmapped string")
    out = C.canonical_turns(df, "body")
    assert out.columns == ["k", "body", "layout", "turns", "unmapped"]
    got = {r["k"]: (r["layout"], len(r["turns"]), r["unmapped"]) for r in out.collect()}
    assert got == {0: ("messages", 1, None), 1: (None, 0, C.MALFORMED), 2: (None, 0, C.NULL), 3: (None, 0, C.NO_LAYOUT), 4: (None, 0, C.NO_LAYOUT), 5: (None, 0, C.NO_LAYOUT), 6: (None, 0, C.TOO_LARGE), 7: (None, 0, C.MALFORMED)}
    structs = spark.createDataFrame([(([("user", "hi")],), "l", "t")], "record struct<messages: array<struct<role: string, content: string>>>, layout string, turns string")
    r = C.canonical_turns(structs, "record").first()
    assert (r["layout"], len(r["turns"]), r["unmapped"]) == ("messages", 1, None)
    r = C.canonical_turns(structs.select(F.struct(F.lit(1).alias("odd")).alias("record")), "record").first()
    assert (r["layout"], r["turns"], r["unmapped"]) == (None, [], C.NO_LAYOUT)


def test_a_structure_of_many_megabytes_ends_no_run(spark):
    df = spark.range(1).select(F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(900_000)), lambda k: F.concat(F.lit('"key'), k, F.lit('": '), k)), ", "), F.lit("}")).alias("body"))
    df = df.unionByName(spark.createDataFrame([('{"messages": [{"role": "user", "content": "hi"}]}',)], "body string"))
    out = C.canonical_turns(df, "body").select(F.octet_length("body").alias("n"), "layout", "unmapped").collect()
    large, small = sorted(out, key=lambda r: -r["n"])
    assert large["n"] > 16 << 20 and large["layout"] is None and large["unmapped"] in (C.NO_LAYOUT, C.TOO_LARGE) and small["layout"] == "messages"
