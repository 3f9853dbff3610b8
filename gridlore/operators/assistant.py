"""Threads, their history, the site's context summary and the reply built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.text import history_line, normalise_space, plural, strip, thread_title, truncate, truthy
from gridlore.operators.joins import with_counts
from gridlore.operators.kpis import tail_of

TAIL, TITLE_CHARS = 30, 512


def thread_list(threads: DataFrame, messages: DataFrame, updated: str = "updated_at") -> DataFrame:
    """Threads with message counts, last updated first. Later messages don't move a thread; only its own row does."""
    return with_counts(threads, messages, "id", "conversation_id", "id").orderBy(F.desc(updated), "id")


def titles(messages: DataFrame, thread: str, order: str, content: str, role: str = "role") -> DataFrame:
    """(thread, title): from the first user message of each thread, aggregated on the map side."""
    first = F.min_by(F.col(content), F.col(order))
    return messages.where(F.col(role) == "user").groupBy(thread).agg(thread_title(first).alias("title"))


def with_titles(threads: DataFrame, messages: DataFrame, thread: str, order: str, content: str, role: str = "role") -> DataFrame:
    """Threads without a title take the one of their first user message; others keep theirs."""
    first = titles(messages, thread, order, content, role).withColumnsRenamed({thread: "__thread", "title": "__first"})
    out = threads.join(first, F.col("id") == F.col("__thread"), "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "__first"))
    return out.drop("__thread", "__first")


def renamed(threads: DataFrame, messages: DataFrame, names: DataFrame, site_id: int) -> DataFrame:
    """The tenant's threads named anew by names (id, title), with their message counts; other threads give no row.

    Titles are normalised and cut; a title without a visible character is not valid and renames nothing.
    """
    new = names.select(F.col("id").alias("__id"), F.left(normalise_space(F.col("title")), F.lit(TITLE_CHARS)).alias("__title")).where("__title <> ''")
    mine = threads.where(F.col("site_id") == site_id).join(new, F.col("id") == F.col("__id")).withColumn("title", F.col("__title")).drop("__id", "__title")
    return with_counts(mine, messages, "id", "conversation_id", "id")


def said(messages: DataFrame, thread: str, text: Column, at: Column, role: str = "user") -> DataFrame:
    """A new message row for each row of messages: stripped text under the role. Writing is an append."""
    return messages.select(F.col(thread).alias("conversation_id"), F.lit(role).alias("role"), strip(text).alias("content"), at.alias("created_at"))


def shown(messages: DataFrame, key: list[str], at: str) -> DataFrame:
    """Messages as the page lists them: `db-<id>` and epoch milliseconds."""
    return messages.withColumns({"id": F.concat(F.lit("db-"), F.concat_ws("-", *key)), "at": F.unix_millis(F.col(at).cast("timestamp"))})


def history(messages: DataFrame, thread: str, order: list[str], role: str, content: str, n: int = TAIL) -> DataFrame:
    """(thread, history): the last n messages of each thread, oldest first, one line each."""
    tail = tail_of(messages, thread, order, n).withColumn("__line", history_line(F.col(role), F.col(content)))
    lines = F.array_sort(F.collect_list(F.struct("place", "__line")))
    return tail.groupBy(thread).agg(F.array_join(F.transform(lines, lambda x: x["__line"]), "\n").alias("history"))


def record_counts(records: DataFrame, site: str, name: str, applied: str | None = None) -> DataFrame:
    """(site_id, count) of each tenant, and of the applied records where a flag is named."""
    counts = [F.count("*").alias(name)] + ([F.count_if(F.coalesce(F.col(applied), F.lit(False))).alias(f"{name}_applied")] if applied else [])
    return records.groupBy(F.col(site).alias("site_id")).agg(*counts)


def site_context(sites: DataFrame, chains: DataFrame, alerts: DataFrame, mitigations: DataFrame, register: Column) -> DataFrame:
    """Sites with the numbers of their stored records, and assets in their register; nothing stored: 0.

    Sites and records are tagged rows of one union, counted on the map side, so there is one shuffle by site.
    """
    kinds = {"chains": (chains, F.lit(False)), "alerts": (alerts, F.lit(False)), "mitigations": (mitigations, F.coalesce(F.col("applied"), F.lit(False)))}
    own = sites.withColumn("register_assets", F.coalesce(F.json_array_length(F.get_json_object(register, "$.assets")), F.lit(0)))
    rows = own.select(F.col("id").alias("__site"), F.lit("site").alias("__kind"), F.lit(False).alias("__applied"), F.struct(*own.columns).alias("__own"))
    for kind, (records, applied) in kinds.items():
        tagged = records.where("site_id IS NOT NULL").select(F.col("site_id").alias("__site"), F.lit(kind).alias("__kind"), applied.alias("__applied"))
        rows = rows.unionByName(tagged, allowMissingColumns=True)
    counts = [F.count_if(F.col("__kind") == kind).alias(kind) for kind in kinds] + [F.count_if(F.col("__applied")).alias("mitigations_applied")]
    counted = rows.groupBy("__site").agg(F.any_value("__own", F.lit(True)).alias("__own"), *counts)
    return counted.where("__own IS NOT NULL").select("__own.*", *kinds, "mitigations_applied")


def reply(context: dict[str, str], question: Column, past: Column) -> Column:
    """Answer made of the site's figures, its architecture and earlier turns where there are any, and the question."""
    c = {k: F.col(v) for k, v in context.items()}
    head = F.concat(
        F.lit("Site "), c["site_name"], F.lit(": "), plural(c["assets"], "asset"), F.lit(", "), plural(c["chains"], "attack chain"), F.lit(", "), plural(c["alerts"], "alert"),
        F.lit(", "), plural(c["mitigations"], "mitigation plan"), F.lit(" ("), c["applied"].cast("string"), F.lit(" applied).\n"),
    )
    architecture = F.when(truthy(c["architecture"]), F.concat(F.lit("Architecture: "), c["architecture"], F.lit("\n"))).otherwise("")
    earlier = F.when(truthy(past), F.concat(F.lit("\nEarlier in this thread:\n"), past, F.lit("\n"))).otherwise("")
    return F.concat(head, architecture, earlier, F.lit("\nQuestion: "), truncate(strip(question), 500), F.lit("\n"))
