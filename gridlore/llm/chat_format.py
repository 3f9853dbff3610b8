"""Chat formatting chosen by schema fingerprints.

A record's nested field paths are hashed; the hash picks a declarative mapping that says where turns, roles and texts
lie. All layouts become one canonical array of (role, text), which a template renders together with a loss mask. All of
it is DataFrame code: no Python runs on executors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from gridlore.llm.common import let, read

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: JSON of more bytes could pass a variant's 128 MiB or the parser's 20,000,000 characters a string; its texts don't become a variant.
SMALL_JSON = 4 << 20
NULL, MALFORMED, TOO_LARGE, NO_LAYOUT = "null", "malformed", "too large or malformed", "no layout"  # what `unmapped` says


@dataclass(frozen=True)
class Layout:
    """How a record of given field paths becomes turns.

    paths: every leaf path, `[]` for array elements. Either `turns` names an array with `role` and `text` fields in its
    elements, or `fields` lists (role, path) pairs, each a turn of its own, left out where null or empty.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths: tuple[str, ...]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout("conversation", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("turn rows", ("turns[].role", "turns[].text", "turns[].turn"), "turns", "role", "text"),
    Layout("instruction", ("instruction", "input", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction without input", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt with system", ("system", "prompt", "completion"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
)
#: Role names of other layouts in canonical form; other names stay.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def leaf_paths(record: Column) -> Column:
    """Sorted distinct leaf paths of a variant, two levels deep with arrays of objects.

    Read from the record's own schema string, whose nesting is at most objects in an array in an object; anything else
    keeps its type text in the path and so matches no mapping.
    """
    schema = F.schema_of_variant(record)
    leaf = r"(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\d+\))"
    flat = F.regexp_replace(schema, rf": {leaf}(?=[,>])", "")

    def level(part: Column) -> Column:
        name, inner = F.regexp_extract(part, r"(?s)^(.*?): ARRAY<OBJECT<(.*)>>$", 1), F.regexp_extract(part, r"(?s)^(.*?): ARRAY<OBJECT<(.*)>>$", 2)
        return F.when(name != "", F.transform(F.split(inner, ", "), lambda x: F.concat(name, F.lit("[]."), x))).otherwise(F.array(part))

    parts = F.regexp_extract_all(F.regexp_extract(flat, r"(?s)^OBJECT<(.*)>$", 1), F.lit(r"(?s)([^,<>]+(?:<(?:[^<>]|<[^<>]*>)*>)?)(?:, |$)"), 1)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, level))))


def fingerprint_of(record: Column) -> Column:
    return F.md5(F.array_join(leaf_paths(record), "\n").cast("binary"))


def structure(body: Column) -> Column:
    """JSON of the same field paths as a long JSON string: texts emptied, numbers 0, runs of equal objects once.

    Each match goes on where the last one ended, so it starts outside strings; strings before a colon are names and
    stay. The quantifiers are possessive, which the regex engine runs as loops and not as recursion.
    """
    said = r'"(?:[^"\\]++|\\(?s:.))*+'
    emptied = F.regexp_replace(body, rf'\G([^"]*+(?:{said}"\s*+:[^"]*+)*+){said}(?:"|\\?\z)', '$1""')
    plain = F.regexp_replace(emptied, r'("\s*+:\s*+)-?\d[\d.eE+-]*+', "$10")
    return F.regexp_replace(plain, r"(\{[^{}]*+\})(?:\s*+,\s*+\1)++", "$1")


def paths_of(kind: DataType, path: str = "") -> Iterator[str]:
    """Leaf paths of a column type, written like those of a Layout."""
    if isinstance(kind, ArrayType):
        yield from paths_of(kind.elementType, f"{path}[]")
    elif isinstance(kind, StructType):
        for f in kind.fields:
            yield from paths_of(f.dataType, f"{path}.{f.name}" if path else f.name)
    else:
        yield path


def items_type(layout: Layout) -> str:
    return f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"


def canonical(layout: Layout, get: Callable[[str, str], Column]) -> Column:
    """Canonical turns under a layout, for get(field, type); null role or text: empty."""
    if layout.turns:
        turns = F.transform(get(layout.turns, items_type(layout)), lambda t: F.struct(t[layout.role].alias("role"), t[layout.text].alias("text")))
    else:
        parts = [F.struct(F.lit(role).alias("role"), get(path, "string").alias("text")) for role, path in layout.fields]
        turns = F.filter(F.array(*parts), lambda t: F.coalesce(t["text"], F.lit("")) != "")
    renamed = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.transform(turns, lambda t: F.struct(F.coalesce(F.try_element_at(renamed, F.coalesce(t["role"], F.lit(""))), t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def mapped(record: Column, layout: Layout) -> Column:
    """Canonical turns of a variant record."""
    return canonical(layout, lambda path, kind: F.variant_get(record, f"$.{path}", kind))


def mapped_json(body: Column, layout: Layout) -> Column:
    """Canonical turns of a long JSON string, read without a bound on a string; null if it is malformed."""
    kinds = [f"`{layout.turns}` {items_type(layout)}"] if layout.turns else [f"`{path}` string" for _, path in layout.fields]
    record = F.from_json(body, ", ".join([*kinds, "__bad string"]), {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": "__bad"})
    return let(record, lambda r: F.when(r["__bad"].isNull(), canonical(layout, lambda path, _: r[path])))


def canonical_turns(records: DataFrame, body: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout, turns and unmapped added, for a column of JSON strings or of structs; columns of these names are replaced.

    Malformed JSON, null and layouts without a mapping give a null layout and no turns (an empty array), and `unmapped` says
    which it is; the rows stay. Texts of a struct, and of JSON over SMALL_JSON bytes, never enter a variant. JSON whose
    structure alone has more bytes than that can't be told from malformed JSON and is `too large or malformed`.
    """
    kind, none = records.schema[body].dataType, F.array().cast(TURNS)
    name, turns = F.lit(None).cast("string"), none
    if isinstance(kind, StructType):
        found = fingerprint(tuple(set(paths_of(kind))))
        for x in (x for x in layouts if x.fingerprint == found):
            got = canonical(x, lambda path, _: F.col(body)[path])
            there = F.size(got) > 0 if x.turns else F.col(body).isNotNull()
            name, turns = F.when(there, F.lit(x.name)), F.when(there, got.cast(TURNS))
        reason = F.when(F.col(body).isNull(), NULL).when(name.isNull(), NO_LAYOUT)
        return records.withColumns({"layout": name, "turns": F.coalesce(turns, none), "unmapped": reason})
    long = F.octet_length(body) > SMALL_JSON
    out = records.withColumn("__s", F.when(long, structure(F.col(body))).otherwise(F.col(body)))
    out = out.withColumn("__v", F.try_parse_json(F.col("__s")))
    lost = F.col("__v").isNull() & (F.octet_length("__s") > SMALL_JSON)
    out = out.withColumn("__fp", F.coalesce(fingerprint_of(F.col("__v")), F.lit("")))
    for x in layouts:
        hit = F.col("__fp") == x.fingerprint
        got = F.when(long, mapped_json(F.col(body), x).cast(TURNS)).otherwise(mapped(F.col("__v"), x).cast(TURNS))
        name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, got).otherwise(turns)
    # long JSON whose texts turn out malformed has a layout's structure, but null turns
    out = out.withColumns({"layout": name, "turns": turns})
    malformed = F.coalesce(long & F.col("turns").isNull() & F.col("layout").isNotNull(), F.lit(False))
    reason = F.when(F.col(body).isNull(), NULL).when(lost, TOO_LARGE).when(F.col("__v").isNull() | malformed, MALFORMED).when(F.col("layout").isNull(), NO_LAYOUT)
    return out.withColumns({"unmapped": reason, "layout": F.when(~malformed, F.col("layout")), "turns": F.coalesce("turns", none)}).drop("__s", "__v", "__fp")


def escaped(c: Column) -> Column:
    """Free of `<|` and of newlines that could end a role: `\\` -> `\\b`, `<|` -> `<\\p`."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescaped(c: Column) -> Column:
    """Every backslash of an escaped string starts an escape, so the replacements can't overlap."""
    return F.replace(F.replace(c, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\n"))


def unescaped_role(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("\\n"), F.lit("\n")))


def render(turns: Column, trained: str = "assistant") -> Column:
    """Struct of the formatted text and, for each turn, the code points of its segment that carry loss (start, length).

    A segment is START role newline text END newline; the starts count from the segment's own first code point.
    """

    def segment(t: Column) -> Column:
        return F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))

    def mask(t: Column) -> Column:
        begin = F.lit(len(START) + 1) + F.char_length(escaped_role(t["role"]))
        return F.struct(begin.alias("start"), F.when(t["role"] == trained, F.char_length(escaped(t["text"]))).otherwise(F.lit(0)).alias("length"))

    return F.struct(F.array_join(F.transform(turns, segment), "").alias("formatted"), F.transform(turns, mask).alias("loss"))


def segments(formatted: Column) -> Column:
    """Back to one string a turn: control strings can't occur inside escaped texts."""
    return F.transform(F.filter(F.split(formatted, re.escape(START)), lambda s: s != ""), lambda s: F.concat(F.lit(START), s))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text, unescaped."""

    def turn(s: Column) -> Column:
        inner = F.substring(s, F.lit(len(START) + 1), F.char_length(s) - len(START) - len(END) - 1)
        cut = F.instr(inner, "\n")
        return F.struct(unescaped_role(F.left(inner, cut - 1)).alias("role"), unescaped(F.substring(inner, cut + 1, F.char_length(inner))).alias("text"))

    return F.transform(segments(formatted), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.zip_with(segments(formatted), loss, lambda s, m: F.when(m["length"] > 0, unescaped(F.substring(s, m["start"] + 1, m["length"]))).otherwise(F.lit(""))), "")


def gather_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record (a struct of its array of turns) a conversation from rows of one turn each.

    A conversation is one output record and must fit one row (2 GB). Turns of equal number go by role, then text;
    repeated rows stay; null turn numbers come first; null conversation ids make one conversation.
    """
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))), lambda a, b: order_turns(a, b))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(F.struct(turns.alias("turns")).alias("record"))


def order_turns(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for f in ("text", "role"):
        out = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(out)
    same = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return same.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(out)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = canonical_turns(gather_rows(rows), "record").select("conv_id", "layout", render(F.col("turns")).alias("r")).select("conv_id", "layout", "r.*")
    out = out.select("conv_id", "layout", read_back(F.col("formatted")).alias("back"), loss_text(F.col("formatted"), F.col("loss")).alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said_all = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(replace(replace(replace(role, '\', '\b'), '<|', '<\p'), chr(10), '\n')) + 1
           + length(replace(replace(text, '\', '\b'), '<|', '<\p')) + 11)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
