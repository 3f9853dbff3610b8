"""Quality rules learned as a decision list.

Per-document statistics are Spark expressions. From labelled statistics, sequential covering grows conjunctions of
threshold conditions on one part of the rows, prunes them with the other, and takes the covered rows out before the next
rule. A rule stands if its precision, bounded by the counts behind it, is high over all rows and no worse on the pruning
rows; that asks the same of ten labels as of ten million. The list is emitted as one ordered CASE expression. Counting is done by Spark aggregations over binned
statistics; the driver sees a few hundred counts a step. No Python runs on executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import WHITE, let, read, staged, words_of

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
N_BINS, MAX_RULES, MAX_CONDITIONS = 24, 8, 4
MIN_COVER = 3  # bad growing rows that a condition must leave
MIN_PRECISION = 0.85  # (bad + 1) / (covered + 2) of a rule over all rows: five bad rows and no good one are the least
MIN_PRUNED = 0.9  # share of bad rows among the pruning rows that a rule covers, if it covers any


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, each counted once.

    Window hashes are sorted inside the row, so equal windows are neighbours: n log n for any length.
    """

    def sorted_windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.sort_array(F.slice(hashed, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return let(F.transform(twice, lambda x: x["i"]), lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))

    return let(words, lambda w: let(sorted_windows(w), covered))


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the counts the rules read. Null text: all counts 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "")

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        )

    return docs.select(
        F.col(doc_id).alias("doc_id"), let(words_of(body), counts).alias("w"), F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    ).select("doc_id", "w.*", "n_symbols", "n_upper", "l.*")


def rate(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": rate("word_chars", "n_words"),
        "symbols_per_word": rate("n_symbols", "n_words"),
        "dup_line_share": rate("n_dup_lines", "n_lines"),
        "repeat_share": rate("n_repeat_words", "n_words"),
        "distinct_share": rate("n_distinct_words", "n_words"),
        "upper_share": rate("n_upper", "word_chars"),
        "words_per_line": rate("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order: the first that holds rejects with its label; no rule: the default."""

    rules: tuple[tuple[Condition, ...], ...]
    default: bool = True

    def column(self) -> Column:
        out = F.lit(self.default)
        for rule in reversed(self.rules):
            out = F.when(conjunction(rule), F.lit(not self.default)).otherwise(out)
        return out

    def __str__(self) -> str:
        lines = [f"IF {' AND '.join(map(str, r))} THEN {not self.default}" for r in self.rules]
        return "\n".join([*lines, f"ELSE {self.default}"])


def conjunction(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def bin_of(value: Column, marks: list[float]) -> Column:
    """How many of the marks lie below value."""
    return F.size(F.filter(F.array(*[F.lit(float(m)) for m in marks]), lambda m: m < value))


def foil(p0: int, n0: int, p1: int, n1: int) -> float:
    """Information gained when a rule's cover shrinks from (p0, n0) to (p1, n1)."""
    if not p1:
        return -1.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def widened(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The rule with each threshold moved half way to the next value the condition covers or leaves out."""
    cols = features()
    ends = []
    for k, c in enumerate(rule):
        value = cols[c.feature]
        ends += [F.max(F.when(value <= c.threshold, value)).alias(f"low{k}"), F.min(F.when(value > c.threshold, value)).alias(f"high{k}")]
    r = rows.agg(*ends).first()
    mid = [(r[f"low{k}"] + r[f"high{k}"]) / 2 if r[f"low{k}"] is not None and r[f"high{k}"] is not None else c.threshold for k, c in enumerate(rule)]
    return tuple(Condition(c.feature, c.above, m) for c, m in zip(rule, mid))


def learn(labelled: DataFrame, bad: str = "bad", max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_cover: int = MIN_COVER, min_precision: float = MIN_PRECISION, min_pruned: float = MIN_PRUNED) -> DecisionList:
    """Decision list from rows with the statistics and a boolean `bad`; all labelled rows are counted."""
    cols = features()
    values = staged(labelled.select("doc_id", F.col(bad).alias("bad"), "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words"), "labelled")
    quantiles = [k / N_BINS for k in range(1, N_BINS)]
    row = values.where("bad").agg(*[F.percentile_approx(c, quantiles, 1000).alias(f) for f, c in cols.items()]).first()
    every = values.agg(*[F.percentile_approx(c, quantiles, 1000).alias(f) for f, c in cols.items()]).first()
    if row is None or row[0] is None:
        return DecisionList(())
    marks = {f: sorted({*row[f], *every[f]}) for f in cols}
    bins = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(c, marks[f]).alias("bin")) for f, c in cols.items()])
    prune = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    data = staged(values.select("*", prune.alias("prune"), bins.alias("bins")), "labelled-bins")

    def best(rows: DataFrame, held: tuple[Condition, ...]) -> tuple[float, Condition | None, int, int]:
        """The condition of most gain over the growing rows that the rule so far covers."""
        got = rows.where(~F.col("prune") & conjunction(held)).select("bad", F.explode("bins").alias("b")).groupBy("b.f", "b.bin", "bad").count().collect()
        top: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
        for f in cols:
            pos, neg = [0] * (len(marks[f]) + 1), [0] * (len(marks[f]) + 1)
            for r in got:
                if r["f"] == f:
                    (pos if r["bad"] else neg)[r["bin"]] = r["count"]
            p0, n0, p, n = sum(pos), sum(neg), 0, 0
            for k, m in enumerate(marks[f]):
                p, n = p + pos[k], n + neg[k]
                for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                    if p1 >= min_cover and (gain := foil(p0, n0, p1, n1)) > top[0] + 1e-9:
                        top = (gain, Condition(f, above, float(m)), p1, n1)
        return top

    rules: list[tuple[Condition, ...]] = []
    left = data
    for _ in range(max_rules):
        rule: tuple[Condition, ...] = ()
        while len(rule) < max_conditions:
            _, condition, p1, n1 = best(left, rule)
            if condition is None:
                break
            rule += (condition,)
            if not n1:
                break
        if not rule:
            break
        cuts = [rule[:k] for k in range(1, len(rule) + 1)]
        r = left.agg(*[F.count_if(conjunction(c) & (F.col("bad") == b) & (F.col("prune") | F.lit(a))).alias(f"{k}_{b}_{a}") for k, c in enumerate(cuts) for b in (True, False) for a in (True, False)]).first()
        worth = []
        for k in range(len(cuts)):
            bad_all, good_all, bad_pruned, good_pruned = (r[f"{k}_{b}_{a}"] for a in (True, False) for b in (True, False))
            if bad_pruned >= min_pruned * (bad_pruned + good_pruned):
                worth.append(((bad_all + 1) / (bad_all + good_all + 2), bad_all, -k))
        if not worth or max(worth)[0] < min_precision:
            break
        rules.append(widened(left, cuts[-max(worth)[2]]))
        left = left.where(~conjunction(rules[-1]))
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DecisionList]:
    """Statistics of every document with base_failed and kept, and the list that decided.

    labels: (doc_id, quality), 1 for good; several labels of an id are averaged; null labels and ids are left out.
    Without usable labels the list is empty and keeps whatever the base rule keeps. Repeated rows are judged alike.
    """
    stats = staged(statistics(docs, text, doc_id), "quality-statistics")
    truth = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    rules = learn(stats.where(~base_failed()).join(truth, "doc_id"))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column()), rules


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
