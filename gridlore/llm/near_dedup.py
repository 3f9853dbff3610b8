"""Near-duplicate documents: many universal hash minima, banding, verification, components by alternating stars.

Documents with equal shingle sets form a class and its smallest id stands for it, so copies are never paired. In each
band bucket the smallest representative is the hub; hub and members are compared by signature and then on full sets.
What is still apart inside a bucket after the hub's links were followed is compared in blocks of the bucket: no task
holds a whole bucket and no bucket is expanded into rows of pairs.

Joins that may meet a hot key read plain exchanges on both sides (their aggregated side is staged), so adaptive
execution can split a hot partition. Joins that carry texts or bands are merge joins at every size of the input. Texts
are shuffled by id once for the hubs' pairs and once for what is apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import read, slice_count, staged

N_HASHES, ROWS = 128, 4  # 32 bands of 4: a pair at 0.8 is missed with probability 5e-8
THRESHOLD = 80  # percent
MARGIN = 0.2  # a pair whose signatures agree on less than threshold - margin isn't looked at again (5.6 deviations: 1e-7)
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000  # representatives of a bucket compared in one block, and their shingles
COLUMNS = 4096  # shingles of an incidence matrix held at a time
SALT_ROWS = 256  # partners of one document that share a copy of its text
PAIRS = 100_000  # pairs of signatures compared at a time


class Shingles:
    """64-bit hashes of a text's distinct k-word shingles, words remembered."""

    def __init__(self, k: int):
        self.k, self.words = k, {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > 250_000:
            known.clear()
        for w in [w for w in set(words) if w not in known]:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.k + 1)
        span = min(self.k, len(words))
        out = np.full(n, span, np.uint64)  # a short text's one shingle differs from any k-word shingle
        for j in range(span):
            out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def coefficients(n: int = N_HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift universal hashes: h(x) = (a x + b mod 2^64) >> 32, a odd."""
    rng = np.random.default_rng(1)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of the shingle that is smallest under each hash: two sets agree where it is the same shingle."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(out, (a[:, None] * shingles[None, k : k + 1024] + b[:, None]).min(1), out=out)
    return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, k: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes), signature (N_HASHES uint16)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingles, (a, b) = Shingles(k), coefficients()
        for batch in batches:
            rows = []
            for t in batch:
                s = shingles.of(t)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), minima(s, a, b).tobytes()))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_hash", "signature"])

    udf = F.pandas_udf(run, "n_shingles long, set_hash binary, signature binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), udf(F.col(text)).alias("s")).select("doc_id", "s.*")


BANDS = N_HASHES // ROWS  # 32: the low five bits of a bucket say its band


def band_rows(reps: DataFrame) -> DataFrame:
    """(bucket, rep) for each representative and band."""

    def bucket(i: Column) -> Column:
        return F.xxhash64(i, F.substring("signature", i * 2 * ROWS + 1, F.lit(2 * ROWS))).bitwiseAND(F.lit(-BANDS).cast("long")).bitwiseOR(i.cast("long"))

    return reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), bucket)).alias("bucket"))


def comparable(m: Column, n: Column, percent: int) -> Column:
    """Whether sets of m and n shingles can reach the threshold: they share no more than the smaller one has."""
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def agreement(pairs: DataFrame, reps: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes allow and whose signatures agree on a share of at least `least`."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        left = np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1)
        return pd.Series((left == np.frombuffer(b"".join(y), np.uint16).reshape(len(y), -1)).mean(1))

    def side(name: str) -> DataFrame:
        return reps.select(F.col("rep").alias(name), F.col("signature").alias(f"sig_{name}"), F.col("n_shingles").alias(f"n_{name}"))

    both = pairs.join(side("b"), "b").join(side("a"), "a").where(comparable(F.col("n_a"), F.col("n_b"), percent))
    return both.where(share("sig_a", "sig_b") >= least).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold. texts: doc_id, text.

    Each text travels to the pairs it is in. A document with many partners is copied once for each SALT_ROWS of them;
    a task holds its set and one partner's at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, last = Shingles(k), None
        mine: list[np.ndarray] = []  # one set, or those of the texts that share the id
        for batch in batches:
            found = []
            for a, salt, b, text in zip(batch["a"], batch["salt"], batch["b"], batch["text"]):
                words = shingles.of(text)
                if b == a:  # the document itself leads its partners
                    if last != (a, salt):
                        last, mine = (a, salt), []
                    if not any(np.array_equal(words, m) for m in mine):
                        mine.append(words)
                elif last == (a, salt):
                    for m in mine:
                        both = len(np.intersect1d(m, words, assume_unique=True))
                        if both and 100 * both >= percent * (len(m) + len(words) - both):
                            found.append((a, b))
                            break
            yield pd.DataFrame(found, columns=["a", "b"])

    salts = staged(pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("n")), "salts")
    partners = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"), F.col("b").alias("doc_id"))
    selves = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.col("a").alias("doc_id"))
    roles = texts.join(partners.unionByName(selves).hint("merge"), "doc_id").select("a", "salt", F.col("doc_id").alias("b"), "text")
    return roles.repartition(slice_count(roles), "a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b")).mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges (a, b), the component being its smallest node.

    Large-star and small-star alternate until the edges stay as they are.
    """

    def with_smallest(both: DataFrame) -> DataFrame:
        return both.join(staged(both.groupBy("u").agg(F.min("v").alias("m")), "smallest"), "u")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    now = mark(edges)
    for _ in range(max_rounds):
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        large = staged(with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large-star")
        ends = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = staged(with_smallest(large).select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        was, now = now, mark(edges)
        if was == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


GROUP = ["bucket", "i", "j"]


def groups_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups, from batches sorted by GROUP."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch[GROUP].to_numpy()
        edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(batch)]
        for n, (p, q) in enumerate(zip(edge, edge[1:])):
            part = batch.iloc[p:q]
            if held and (n or tuple(held[0][GROUP].iloc[0]) != tuple(key[0])):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def likely_partners(groups: Iterator[pd.DataFrame], least: float, percent: int) -> Iterator[pd.DataFrame]:
    """The rows of each group that a row of another component resembles by size and signature, PAIRS at a time."""
    for pdf in groups:
        i, j, band = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), int(pdf["bucket"].iloc[0]) % BANDS
        block, c, n = pdf["block"].to_numpy(), pdf["component"].to_numpy(), pdf["n_shingles"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        wanted = np.zeros(len(pdf), bool)
        sig = None
        step = max(1, PAIRS // max(1, len(right)))
        for k in range(0, len(left), step):
            some = left[k : k + step]
            x, y = np.nonzero((c[some][:, None] != c[right][None, :]) & (100 * np.minimum(n[some][:, None], n[right][None, :]) >= percent * np.maximum(n[some][:, None], n[right][None, :])))
            x, y = some[x], right[y]
            if i == j:
                x, y = x[y > x], y[y > x]
            if not len(x):
                continue
            if sig is None:
                sig = np.frombuffer(b"".join(pdf["signature"]), np.uint16).reshape(len(pdf), -1)
            same = sig[x] == sig[y]
            near = np.flatnonzero(same.mean(1) >= least)
            near = near[same[near].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]  # else an earlier band has the pair
            wanted[x[near]] = wanted[y[near]] = True
        if wanted.any():
            yield pdf.loc[wanted, [*GROUP, "rep", "component", "block"]]


def links_apart(shared: DataFrame, comp: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """Links (a, b) between documents that share a bucket and so far lie in different components.

    The hub has met every member, so only buckets whose other members lie in two components or more are opened. A bucket
    is cut into blocks of about BLOCK members (fewer, if they are long) and each pair of blocks is one group. Sizes and
    signatures first say which members have a likely partner in another component; the full sets of those are then
    intersected all at once. What a group writes is its members and one link for each two components that meet.
    """
    members = shared.where("rep <> hub").select("bucket", "rep")
    placed = staged(members.join(comp.withColumnsRenamed({"node": "rep"}), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component")), "bucket-members")
    sizes = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    open_ = staged(placed.join(sizes.select("bucket").hint("merge"), "bucket", "left_semi").join(reps.select("rep", "signature", "n_shingles").hint("merge"), "rep"), "open-members")
    blocks = open_.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("g"))
    members = open_.join(staged(blocks, "open-buckets"), "bucket")
    block = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    partners = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least(j, "block").alias("i"), F.greatest(j, "block").alias("j")))
    kept = ["bucket", "rep", "component", "signature", "n_shingles", "block"]
    cells = members.withColumn("block", block).select(*kept, F.explode(partners).alias("c")).select(*kept, "c.*")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(k)
        for pdf in groups_of(batches):
            i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
            sets, c, rep, block = [shingles.of(t) for t in pdf["text"]], pdf["component"].to_numpy(), pdf["rep"].to_numpy(), pdf["block"].to_numpy()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            size = np.array([len(x) for x in sets], np.int64)
            both = common_sizes(sets)[np.ix_(left, right)]
            hit = (both > 0) & (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (c[left][:, None] != c[right][None, :])
            x, y = np.nonzero(hit)
            if len(x):
                x, y = left[x], right[y]
                _, first = np.unique(np.column_stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y])]), axis=0, return_index=True)
                yield pd.DataFrame({"a": np.minimum(rep[x], rep[y])[first], "b": np.maximum(rep[x], rep[y])[first]})

    def dealt(df: DataFrame) -> DataFrame:
        """Whole groups in sorted runs. The number of partitions is fixed: the groups' work isn't told by their bytes."""
        return df.repartition(slice_count(df), *GROUP).sortWithinPartitions(*GROUP)

    wanted = dealt(cells).mapInPandas(lambda batches: likely_partners(groups_of(batches), least, percent), "bucket long, i int, j int, rep long, component long, block int")
    named = texts.withColumnsRenamed({"doc_id": "rep"}).join(staged(wanted, "likely-apart").hint("merge"), "rep")
    return dealt(named).mapInPandas(exact, "a long, b long").distinct()


def common_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the incidence matrix of the shingles that two sets or more have."""
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    use = count[inverse] > 1
    row, column = row[use], (np.cumsum(count > 1) - 1)[inverse[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(sets), len(sets)), np.float32), int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, width, COLUMNS):  # float32 counts exactly up to 2^24 shingles
        part = slice(*np.searchsorted(column, [begin, begin + COLUMNS]))
        m = np.zeros((len(sets), min(COLUMNS, width - begin)), np.float32)
        m[row[part], column[part] - begin] = 1
        out += m @ m.T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of docs.

    Words are A-Z lower-cased runs of [^\\x20\\x09-\\x0D]; a set holds the distinct k-word shingles; a text of fewer words
    is one shingle; a text without words, or null, is empty and links with nothing. Rows of equal id are one document:
    what one of their texts is linked with, all of them are, and they share a component. A null id links with nothing,
    has a null component, and is kept. Other columns are not read.
    """
    least = percent / 100 - MARGIN
    all_rows = staged(signatures(docs, k, text, doc_id), "signatures")
    usable = all_rows.where("n_shingles > 0 and doc_id is not null")
    first = F.min_by(F.struct("signature", "n_shingles"), "doc_id")
    reps = staged(usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), first.alias("s")).select("set_hash", "rep", "s.*"), "representatives")
    rows = band_rows(reps)
    hubs = staged(rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub"), "hubs")
    shared = staged(rows.join(hubs.hint("merge"), "bucket"), "shared-buckets")  # most buckets have one member and end here
    pairs = staged(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "star-pairs")
    # several texts of one id: each is a class of its own, and the id joins their representatives
    mixed = usable.groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select("doc_id")
    mixed = usable.join(mixed, "doc_id", "left_semi").join(reps.select("set_hash", "rep"), "set_hash").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    links = staged(verified(staged(agreement(pairs, reps, least, percent), "likely-pairs"), texts, k, percent).unionByName(mixed), "links")
    comp = staged(components(links), "components")
    more = staged(links_apart(shared, comp, reps, texts, k, percent, least), "links-apart")
    if not more.isEmpty():
        comp = staged(components(links.unionByName(more)), "components")
    classes = reps.select("set_hash", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("class_component"))
    linked = all_rows.drop("signature").join(classes.hint("merge"), "set_hash", "left")
    alone = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    out = linked.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_component")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE len(w) WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS sh FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a
)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id, r.doc_id = min(seen) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
