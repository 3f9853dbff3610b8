"""Hashed maximum-entropy language model.

P(w | h) = P(class | h) P(slot | class, h) P(w | class, slot). Both first factors are softmaxes over hashed features of
the history: the word before, the pair of words before, and a skip to the last frequent word. The slots of a class are some frequent words, each alone in its slot, and groups of the other words by their
endings; words of a group share its mass by their smoothed corpus counts, the one unigram part. Features are hashed from
the words themselves, rare ones too. The tables of weights grow with the training tokens. Weights are trained by
distributed gradient updates: in each round every task follows the gradient over its own documents from the common
weights, and the tasks' rows are averaged by how often each task used them, in a tree of bounded groups. Texts are
scored in numpy batches in which each token touches a few weight rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import read, release, staged
from gridlore.llm.toxicity import held_out

HEAD = 65_536  # most frequent words, whose counts are broadcast
CLASSES, SLOTS, WORD_SLOTS = 32, 32, 16  # classes, slots of a class, and those of them that are one frequent word each
SINGLES = CLASSES * WORD_SLOTS  # frequent words with a slot of their own
FREQUENT = 20  # words that the longest skip looks for
LEAST_BITS, MOST_BITS, TOKENS_PER_ROW = 12, 16, 64  # rows of a weight table: a power of two in these bounds by the training tokens
CLASS_FEATURES, SLOT_FEATURES = 3, 2
FEATURES = CLASS_FEATURES + SLOT_FEATURES
ROUNDS, LEARNERS, RATE, BATCH = 4, 4, 0.15, 8192  # LEARNERS: of a round at least
LIMIT = np.float32(60.0)  # of a score: 32 exponentials of it are finite in single precision
RUN = 12  # members of a row in a batch that are added one by one over all rows; the rest of longer runs at once
LEARNER_ROWS = 64  # training tokens a learner gets for each weight row at least, so that weights sent stay a share of the input
FLUSH = 300_000  # distinct words a task counts before it emits them
BLOCK, FAN = 1024, 32  # weight rows of a block; blocks summed in one group of the tree
END = ""  # no word is empty
SEEDS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def group_of(word: bytes) -> int:
    """Class and slot, as class * SLOTS + slot, of a word without a slot of its own."""
    h = zlib.crc32(word[-3:])
    return h % CLASSES * SLOTS + WORD_SLOTS + (h >> 8) % (SLOTS - WORD_SLOTS)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, code, c) over all texts of train, the end counted once a text as the empty word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": b"\n".join(n).decode().split("\n"), "c": list(n.values())})
            n.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                n.update(words(text))
                n[b""] += 1
                if len(n) > FLUSH:
                    yield flush()
        if n:
            yield flush()

    counts = train.select("text").mapInPandas(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    h = F.crc32(F.substring(F.col("word").cast("binary"), -3, 3))  # group_of as a column
    slot = F.pmod(F.shiftright(h, 8), F.lit(SLOTS - WORD_SLOTS)) + WORD_SLOTS
    return counts.select("word", (F.pmod(h, F.lit(CLASSES)) * SLOTS + slot).cast("int").alias("code"), "c")


class Symbols:
    """Word -> symbol: 32 bits of hash, its rank in the head (the head's size for all others), its class and slot."""

    def __init__(self, head: dict[bytes, int]):
        self.size = len(head)
        self.head = {w: symbol(w, k, k % CLASSES * SLOTS + k // CLASSES if k < SINGLES else group_of(w)) for w, k in head.items()}

    def of(self, said: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.head.get, said, repeat(-1)), np.int64, len(said))
        rare = np.flatnonzero(out < 0)
        some = list(map(said.__getitem__, rare.tolist()))
        whole, end = (np.fromiter(map(zlib.crc32, x), np.int64, len(some)) for x in (some, [w[-3:] for w in some]))
        code = end % CLASSES * SLOTS + WORD_SLOTS + (end >> 8) % (SLOTS - WORD_SLOTS)  # group_of
        out[rare] = (whole << (CODE_BITS + RANK_BITS)) | (self.size << CODE_BITS) | code
        return out


CODE_BITS, RANK_BITS = (CLASSES * SLOTS - 1).bit_length(), 18


def symbol(word: bytes, rank: int, code: int) -> int:
    return (zlib.crc32(word) << (CODE_BITS + RANK_BITS)) | (rank << CODE_BITS) | code


def frequent(counts: DataFrame, most: int) -> list:
    """Rows of the most frequent words, at most `most` and all that share a count step: no task sends more than its part.

    Counts fall into steps of about one part in 64; the steps are few, and the lowest that still fits is the bound.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > most:
            break
        least = r["s"]
    rows = counts.where(step >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r["c"], r["word"]))


@dataclass(frozen=True)
class Vocabulary:
    """What of the corpus counts is broadcast: the head, and totals."""

    head: dict[bytes, int]
    log_count: np.ndarray  # log10(c + 1) by rank; 0 for all words outside the head
    log_total: np.ndarray  # log10 of the mass of each class and slot; 0 for the slots of one word
    tokens: int
    distinct: int

    @classmethod
    def of(cls, counts: DataFrame, most: int = HEAD) -> Vocabulary:
        tokens, distinct = counts.agg(F.sum("c"), F.count("*")).first()
        mass = np.ones(CLASSES * SLOTS)  # one unknown word a group
        for r in counts.groupBy("code").agg(F.sum(F.col("c") + 1).alias("m")).collect():
            mass[r["code"]] += r["m"]
        top = frequent(counts.where(F.col("word") != END), most - 1)
        end = counts.where(F.col("word") == END).first()
        log_count, head = np.zeros(len(top) + 2), {b"": 0}
        if end:
            log_count[0] = np.log10(end["c"] + 1)
            mass[end["code"]] -= end["c"] + 1
        for k, r in enumerate(top, 1):
            head[r["word"].encode()] = k
            log_count[k] = np.log10(r["c"] + 1)
            if k < SINGLES:
                mass[r["code"]] -= r["c"] + 1
        log_total = np.log10(mass)
        log_total.reshape(CLASSES, SLOTS)[:, :WORD_SLOTS] = 0
        return cls(head, log_count, log_total, tokens or 0, distinct)

    @property
    def bits(self) -> int:
        """Bits of a weight row's number."""
        return min(MOST_BITS, max(LEAST_BITS, int(self.tokens // TOKENS_PER_ROW).bit_length()))


class Batch:
    """Tokens of some texts laid out in one array, each text led in by start symbols."""

    LEAD = 2

    def __init__(self, symbols: Symbols, texts: list[list[bytes]]):
        self.words: list[bytes] = []
        for t in texts:
            self.words += t
            self.words.append(b"")
        self.length = np.array([len(t) + 1 for t in texts])
        told = symbols.of(self.words)
        self.at = np.arange(len(told)) + np.repeat(np.arange(1, len(texts) + 1) * self.LEAD, self.length)
        all_ = np.full(len(told) + len(texts) * self.LEAD, -1, np.int64)
        all_[self.at] = told
        rank, self.hash = (all_ >> CODE_BITS) & ((1 << RANK_BITS) - 1), (all_ >> (CODE_BITS + RANK_BITS)).astype(np.uint64)
        code = told & ((1 << CODE_BITS) - 1)
        self.code, self.rank = code, rank[self.at]
        self.target, self.slot = code // SLOTS, code % SLOTS
        seen = np.where((all_ < 0) | (rank < min(FREQUENT, symbols.size)), np.arange(len(all_)), 0)
        self.seen = np.maximum.accumulate(seen)  # the last frequent word, or start, up to each place

    def rows(self, part: slice, bits: int) -> np.ndarray:
        """(FEATURES, tokens) rows of the two weight tables; those of the slots depend on the class too."""
        at, kind = self.at[part], self.target[part].astype(np.uint64)
        one, two = self.hash[at - 1], self.hash[at - 2]
        far = self.hash[self.seen[at - 1]]
        keys = (one, one * np.uint64(1_000_003) + two, far, one * np.uint64(CLASSES) + kind, far * np.uint64(CLASSES) + kind)
        out = np.empty((FEATURES, len(at)), np.int32)
        for k, (key, seed) in enumerate(zip(keys, SEEDS)):
            mixed = (key + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            out[k] = (mixed >> np.uint64(64 - bits)).astype(np.int32)
        return out


@dataclass
class Weights:
    """The weights of classes by feature row, and of slots by row of feature and class; the last rows are biases."""

    cls: np.ndarray
    slot: np.ndarray

    @classmethod
    def zeros(cls, bits: int) -> Weights:
        return cls(np.zeros(((1 << bits) + 1, CLASSES), np.float32), np.zeros(((1 << bits) + CLASSES, SLOTS), np.float32))

    @property
    def bits(self) -> int:
        return (len(self.cls) - 1).bit_length() - 1

    def logits(self, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the classes, and of the slots of the target classes, within bounds that keep exponentials finite."""
        z = self.cls.take(rows[0], 0)
        for k in range(1, CLASS_FEATURES):
            z += self.cls.take(rows[k], 0)
        z += self.cls[-1]
        y = self.slot.take(rows[CLASS_FEATURES], 0)
        for k in range(CLASS_FEATURES + 1, FEATURES):
            y += self.slot.take(rows[k], 0)
        y += self.slot.take(len(self.cls) - 1 + target, 0)
        return np.clip(z, -LIMIT, LIMIT, out=z), np.clip(y, -LIMIT, LIMIT, out=y)

    def log_probability(self, rows: np.ndarray, target: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(class | h) P(slot | class, h)."""
        z, y = self.logits(rows, target)
        n = np.arange(len(target))
        mine = z[n, target] + y[n, slot]
        np.exp(z, out=z)
        np.exp(y, out=y)
        return mine - np.log(z @ np.ones(CLASSES, np.float32)) - np.log(y @ np.ones(SLOTS, np.float32))


class Learner:
    """AdaGrad over batches of tokens; one accumulator a weight row."""

    def __init__(self, weights: Weights):
        self.weights = Weights(weights.cls.copy(), weights.slot.copy())
        self.used = [np.zeros(len(w), np.float32) for w in (weights.cls, weights.slot)]
        self.squares = [np.full(len(w), 1e-2, np.float32) for w in (weights.cls, weights.slot)]

    def step(self, rows: np.ndarray, target: np.ndarray, slot: np.ndarray) -> None:
        z, y = self.weights.logits(rows, target)
        n = np.arange(len(target))
        for g, right in ((z, target), (y, slot)):
            np.exp(g, out=g)
            g *= (1 / (g @ np.ones(g.shape[1], np.float32)))[:, None]
            g[n, right] -= 1
        for k in range(CLASS_FEATURES):
            self._move(0, *summed(rows[k], z))
        self._move(0, np.array([len(self.weights.cls) - 1]), z.sum(0, keepdims=True), np.array([len(target)], np.float32))
        for k in range(CLASS_FEATURES, FEATURES):
            self._move(1, *summed(rows[k], y))
        kind = np.zeros((CLASSES, len(target)), np.float32)
        kind[target, n] = 1
        count = kind.sum(1)
        here = np.flatnonzero(count)
        self._move(1, len(self.weights.cls) - 1 + here, (kind @ y)[here], count[here])

    def _move(self, table: int, row: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        """A step on distinct rows with the sums of their gradients over n tokens each."""
        weight, squares = (self.weights.cls, self.weights.slot)[table], self.squares[table]
        total = squares.take(row) + np.einsum("ij,ij->i", g, g) / (n * g.shape[1])
        squares[row] = total
        g *= (RATE / np.sqrt(total * n))[:, None]
        new = weight.take(row, 0)
        new -= g
        weight[row] = new
        self.used[table][row] += n


def summed(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of at, the sums of their rows of g, and how many each has."""
    order = np.argsort(at)
    ordered, g = at[order], g.take(order, 0)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    n = np.diff(np.r_[first, len(ordered)])
    if len(first) * RUN < 2 * len(ordered):  # few long runs
        return ordered[first], np.add.reduceat(g, first, axis=0), n.astype(np.float32)
    total = g[first]
    longer = np.flatnonzero(n > 1)
    for j in range(1, RUN):
        if not len(longer):
            break
        total[longer] += g[first[longer] + j]
        longer = longer[n[longer] > j + 1]
    for k in longer.tolist():
        total[k] += g[first[k] + RUN : first[k] + n[k]].sum(0)
    return ordered[first], total, n.astype(np.float32)


def batches_of(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    some: list[list[bytes]] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t) + 1
        if size >= 4 * BATCH:
            yield some
            some, size = [], 0
    if some:
        yield some


def train_round(train: DataFrame, vocabulary: Vocabulary, weights: Weights, tasks: int) -> Weights:
    """New common weights: every task, `tasks` at most, follows the gradient over its rows of train, and the rows of weights that
    tasks used are averaged by how often each used them."""
    context = train.sparkSession.sparkContext
    shared = context.broadcast((vocabulary.head, weights.cls, weights.slot))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, *tables = shared.value
        learner, symbols = Learner(Weights(*tables)), Symbols(head)
        bits = learner.weights.bits
        for texts in batches_of(words(t) for b in batches for t in b["text"]):
            batch = Batch(symbols, texts)
            for k in range(0, len(batch.at), BATCH):
                part = slice(k, k + BATCH)
                learner.step(batch.rows(part, bits), batch.target[part], batch.slot[part])
        if learner.used[0][-1]:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            for table, (weight, all_used) in enumerate(zip((learner.weights.cls, learner.weights.slot), learner.used)):
                for k in range(0, len(weight), BLOCK):
                    used = all_used[k : k + BLOCK]
                    at = np.flatnonzero(used).astype(np.int32)
                    if len(at):
                        yield pd.DataFrame({"table": [table], "block": [k // BLOCK], "task": [task], "value": [pack_rows(at, used[at], weight[k : k + BLOCK][at])]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        width = (CLASSES, SLOTS)[int(pdf["table"].iloc[0])]
        used, value = np.zeros(BLOCK), np.zeros((BLOCK, width))
        for p in pdf["value"]:
            at, n, weight = unpack_rows(p, width)
            used[at] += n
            value[at] += n[:, None] * weight
        at = np.flatnonzero(used).astype(np.int32)
        mean = (value[at] / used[at][:, None]).astype(np.float32)
        return pd.DataFrame({"table": pdf["table"].iloc[:1], "block": pdf["block"].iloc[:1], "task": pdf["task"].iloc[:1] // FAN, "value": [pack_rows(at, used[at].astype(np.float32), mean)]})

    schema = "table int, block int, task int, value binary"
    parts, most = train.select("text").mapInPandas(learn, schema), tasks - 1
    while True:
        parts = parts.groupBy("table", "block", F.floor(F.col("task") / FAN).alias("slice")).applyInPandas(lambda pdf: add(pdf), schema)
        if most < FAN:
            break
        most //= FAN
    out = Weights(weights.cls.copy(), weights.slot.copy())
    for r in parts.collect():  # the weight tables: 2^MOST_BITS rows at most, whatever the input
        into = (out.cls, out.slot)[r["table"]]
        at, _, weight = unpack_rows(r["value"], into.shape[1])
        into[at + r["block"] * BLOCK] = weight
    shared.unpersist()
    return out


def pack_rows(at: np.ndarray, used: np.ndarray, weight: np.ndarray) -> bytes:
    """Weights travel in half precision."""
    return b"".join([np.array([len(at)], np.int32).tobytes(), at.astype(np.int32).tobytes(), used.astype(np.float32).tobytes(), weight.astype(np.float16).tobytes()])


def unpack_rows(pack: bytes, width: int) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(pack, np.int32, 1)[0])
    at, used = np.frombuffer(pack, np.int32, n, 4), np.frombuffer(pack, np.float32, n, 4 + 4 * n)
    return at, used, np.frombuffer(pack, np.float16, n * width, 4 + 8 * n).reshape(n, width).astype(np.float32)


def train_model(train: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after one pass over all of train, cut by a hash of the text into `rounds` parts.

    The number of learners follows from the tokens, LEARNERS at least, so results don't change with the number of shuffle
    partitions; they do follow the order of the input's files. An input of fewer partitions than learners is dealt out by a hash of
    the text.
    """
    weights = Weights.zeros(vocabulary.bits)
    learners = max(LEARNERS, vocabulary.tokens // rounds // (LEARNER_ROWS << vocabulary.bits))
    few = train.rdd.getNumPartitions() < learners
    for k in range(rounds):
        h = F.xxhash64("text")
        part = train.where(F.pmod(h, F.lit(rounds)) == k)
        if few:
            part, tasks = part.repartition(learners, h).sortWithinPartitions(h), max(learners, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        else:
            part, tasks = part.coalesce(learners), learners
        weights = train_round(part, vocabulary, weights, tasks)
        release(train.sparkSession)
    return weights


def score_texts(docs: DataFrame, train: DataFrame, text: str = "text", doc_id: str = "doc_id", head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs; train: (text).

    Null text counts as empty: its one token is the end. Repeated rows get a result each; other columns are not read.
    Words outside the head are looked up in the full counts by a join whose keys are rare by construction.
    """
    train = train.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = staged(word_counts(train), "word-counts")
    release(docs.sparkSession)
    vocabulary = Vocabulary.of(counts, head)
    weights = train_model(train, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights.cls, weights.slot))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        vocab, *tables = shared.value
        weights = Weights(*tables)
        symbols, row, bits, size = Symbols(vocab.head), TaskContext.get().partitionId() << 40, weights.bits, len(vocab.head)
        for pdf in batches:
            ids, done = pdf["doc_id"].tolist(), 0
            for texts in batches_of(words(t) for t in pdf["text"]):
                batch = Batch(symbols, texts)
                logs = np.empty(len(batch.at))
                for k in range(0, len(batch.at), BATCH):
                    part = slice(k, k + BATCH)
                    logs[part] = weights.log_probability(batch.rows(part, bits), batch.target[part], batch.slot[part])
                counted, tail = vocab.log_count[batch.rank], batch.rank >= size
                inside = np.where(batch.slot < WORD_SLOTS, 0.0, counted - vocab.log_total[batch.code])
                begin = np.r_[0, np.cumsum(batch.length)[:-1]]
                model = np.add.reduceat(logs / np.log(10) + inside, begin)
                base, known = np.add.reduceat(counted, begin), np.add.reduceat((~tail).astype(np.int64), begin)
                at = np.flatnonzero(tail)
                rare, edge = list(map(batch.words.__getitem__, at.tolist())), np.searchsorted(at, np.r_[begin, len(tail)]).tolist()
                yield pd.DataFrame({
                    "row": row + np.arange(len(texts)), "doc_id": ids[done : done + len(texts)], "n_tokens": batch.length,
                    "head_known": known, "head_base": base, "head_score": model,
                    "rare": [b" ".join(rare[p:q]).decode() for p, q in zip(edge, edge[1:])],
                })
                row, done = row + len(texts), done + len(texts)

    schema = "row long, doc_id string, n_tokens long, head_known long, head_base double, head_score double, rare string"
    # ids travel as text: pandas would turn a column of longs with a null into doubles
    scored = staged(docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, schema), "head-scores")
    # a text's rare words travel as one string; no word has a space in it
    rare = scored.where("rare <> ''").select("row", F.explode(F.split("rare", " ")).alias("word"))
    met = rare.join(counts.select("word", "c"), "word").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1)).alias("rare_log"))
    out = scored.drop("rare").join(met, "row", "left")
    tokens, distinct = vocabulary.tokens, vocabulary.distinct
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    end_known = F.lit(0 if tokens else 1)  # without training texts the end is unknown too
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0)) - end_known).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + rare_log - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))).alias("base_score"), (F.col("head_score") + rare_log).alias("score"),
    )


def op3_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, docs.where(~held_out(F.col("doc_id"), 7, 2)))
    return out.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
