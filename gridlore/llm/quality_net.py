"""Text quality by a convolutional network over bytes, trained and scored in numpy.

A filter is a table of a weight per byte value at each of its WIDTH places, so a convolution is WIDTH look-ups and sums. Each
filter's maximum is taken over every half chunk; a chunk is two halves in a row, so chunks overlap by one half and cover
the whole text, however long. The greatest, the mean and the least chunk value of every filter go through one hidden layer
into one probability; the least tells of a stretch with little variety. Gradients flow back to the bytes at the maxima.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import read, staged
from gridlore.llm.toxicity import held_out

WIDTH, FILTERS, HIDDEN = 8, 24, 12
HALF = 128  # bytes of half a chunk
TRAIN_DOCS = 6_000  # bound of the labelled rows the network is fitted on, in expectation
TRAIN_BYTES = 16 << 20  # bound of their bytes, in expectation
LONGEST_TRAINED = 256 << 10  # bytes of a text that the fit takes
LEAST_STEPS, EPOCHS, BATCH, RATE, DECAY = 300, 6, 48, 4e-3, 1e-4
BLOCK = 1 << 16  # places convolved at a time
AT_ONCE = 1 << 21  # bytes of texts scored at a time; a longer text alone


@dataclass
class Net:
    """tables: (WIDTH, 256, FILTERS); w1: (3 * FILTERS, HIDDEN); w2: (HIDDEN,)."""

    tables: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def fresh(seed: int = 7, prior: float = 0.5) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return Net(draw(0.15, WIDTH, 256, FILTERS), np.zeros(FILTERS, np.float32), draw((3 * FILTERS) ** -0.5, 3 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN**-0.5, HIDDEN), np.array([np.log(prior / (1 - prior))], np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.w1, self.b1, self.w2, self.b2]


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each from a whole half on, with WIDTH - 1 zeros or more behind it; the halves of each text."""
    halves = np.array([(len(t) + WIDTH - 1 + HALF - 1) // HALF for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves)), np.uint8), halves


def maxima(net: Net, data: np.ndarray, halves: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's greatest value in each half, and the place of it in the half. Memory follows BLOCK, not the data.

    The last WIDTH - 1 places of a text, all behind its bytes, would see the next text and don't count.
    """
    n, best, where = len(data), [], []
    last = np.zeros(n // HALF, bool)
    last[np.cumsum(halves) - 1] = True
    data = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
    total, one = (np.empty((min(n, BLOCK), FILTERS), net.tables.dtype) for _ in range(2))
    for lo in range(0, n, BLOCK):
        m = min(BLOCK, n - lo)
        out, add = total[:m], one[:m]
        np.take(net.tables[0], data[lo : lo + m], axis=0, out=out, mode="clip")
        for j in range(1, WIDTH):
            np.take(net.tables[j], data[lo + j : lo + j + m], axis=0, out=add, mode="clip")
            out += add
        cut = out.reshape(-1, HALF, FILTERS)
        cut[last[lo // HALF : (lo + m) // HALF], HALF - WIDTH + 1 :] = -np.inf
        if places:
            at = cut.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(cut, at[:, None], 1)[:, 0])
        else:
            best.append(cut.max(1))
    return np.concatenate(best), np.concatenate(where) if places else None


def pooled(best: np.ndarray, bias: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(texts, 3 * FILTERS): greatest, mean and least chunk value of each filter; what the way back needs."""
    value = np.maximum(best + bias, 0)
    first = np.cumsum(halves) - halves
    # chunk i is the halves i and i + 1 of a text; a text of one half is one chunk
    last = np.zeros(len(best), bool)
    last[first + halves - 1] = True
    after = np.where(last | (np.arange(len(best)) + 1 == len(best)), np.arange(len(best)), np.arange(len(best)) + 1)
    pick = np.where(value[after] > value, after[:, None], np.arange(len(best))[:, None])
    chunk = np.take_along_axis(value, pick, 0)
    many = np.maximum(halves - 1, 1)
    counts = ~last
    counts[first[halves == 1]] = True
    mean = np.add.reduceat(np.where(counts[:, None], chunk, 0), first) / many[:, None]
    most = np.maximum.reduceat(value, first)
    least = np.minimum.reduceat(np.where(counts[:, None], chunk, np.inf), first)
    return np.concatenate([most, mean, least], 1).astype(best.dtype), (chunk, value, first, pick, counts, many, most, least)


def forward(net: Net, best: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, tuple]:
    v, back = pooled(best, net.bias, halves)
    hidden = np.tanh(v @ net.w1 + net.b1)
    z = hidden @ net.w2 + net.b2[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (v, hidden, back)


def gradients(net: Net, texts: list[bytes], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log-loss and its gradient in every weight."""
    data, halves = padded(texts)
    best, where = maxima(net, data, halves, places=True)
    p, (v, hidden, (chunk, value, first, pick, counts, many, most, least)) = forward(net, best, halves)
    q = np.clip(p, 1e-7, 1 - 1e-7)
    loss = -np.where(y > 0, np.log(q), np.log(1 - q)).mean()
    dz = ((p - y) / len(y)).astype(net.w2.dtype)
    dh = dz[:, None] * net.w2 * (1 - hidden**2)
    dv = dh @ net.w1.T
    row = np.repeat(np.arange(len(halves)), halves)
    d = np.zeros_like(value)
    share = np.where(counts[:, None], (dv[:, FILTERS : 2 * FILTERS] / many[:, None])[row], 0)
    for at, part, to in ((value == most[row], dv[:, :FILTERS], d), ((chunk == least[row]) & counts[:, None], dv[:, 2 * FILTERS :], share)):
        to += at * (part / np.add.reduceat(at, first, dtype=np.float32))[row]
    np.add.at(d, (pick, np.arange(FILTERS)[None, :]), share)
    d *= value > 0
    h, f = np.nonzero(d)
    at, pull = h * HALF + where[h, f], d[h, f]
    data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    tables = np.stack([np.bincount(data[at + j].astype(np.int64) * FILTERS + f, pull, 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)])
    return float(loss), [tables, d.sum(0), v.T @ dh, dh.sum(0), hidden.T @ dz, np.array([dz.sum()])]


def train(texts: list[bytes], y: np.ndarray, seed: int = 7) -> Net:
    """Adam over shuffled batches, the same for the same rows in the same order. Weights of filters decay a little."""
    net = Net.fresh(seed, float(np.clip(y.mean(), 0.01, 0.99)))
    rng = np.random.default_rng(seed)
    m, v = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    steps = max(LEAST_STEPS, EPOCHS * -(-len(texts) // BATCH))
    order: list[int] = []
    for t in range(1, steps + 1):
        if len(order) < BATCH:
            order += rng.permutation(len(texts)).tolist()
        rows, order = order[:BATCH], order[BATCH:]
        _, g = gradients(net, [texts[k] for k in rows], y[rows])
        rate = RATE * min(1, 2 * (1 - t / (steps + 1))) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for w, a, b, d in zip(net.weights(), m, v, g):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            w -= (rate * a / (np.sqrt(b) + 1e-8) + RATE * DECAY * w).astype(w.dtype)
    return net


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, quality) of labelled rows that aren't held out: at most TRAIN_DOCS rows and TRAIN_BYTES bytes in expectation.

    Chosen by a hash of the id, then, for the texts of an id that has many, of id and text. Null labels are left out; an id
    with several labels is good only if all say so. Repeated rows count once. Texts over LONGEST_TRAINED bytes are scored
    but not fitted on.
    """
    truth = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    bits = F.lit(1 << 30)
    share = min(1.0, TRAIN_DOCS / max(1, truth.count()))
    chosen = truth.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), bits) < int(share * (1 << 30)))
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST_TRAINED)
    rows = body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.xxhash64("text").alias("own")).agg(F.first("text").alias("text"), F.first("quality").alias("quality"))
    rows = staged(rows, "quality-labelled")
    many, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    again = min(1.0, TRAIN_DOCS / max(1, many), TRAIN_BYTES / max(1, size))
    return rows.where(F.pmod(F.xxhash64("own", "doc_id"), bits) < int(again * (1 << 30))).select("doc_id", "text", "quality")


def fit(rows: DataFrame) -> Net:
    """The network for rows (doc_id, text, quality); one class alone, or none, gives that class's share as every score."""
    told = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))
    texts, y = [r["text"].encode() for r in told], np.array([r["quality"] for r in told], np.float32)
    if len({*y.tolist()}) == 2:
        return train(texts, y)
    net = Net.fresh(prior=0.99 if len(y) and y[0] > 0 else 0.01 if len(y) else 0.5)
    net.w2[:] = 0
    return net


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    data, halves = padded(texts)
    return forward(net, maxima(net, data, halves)[0], halves)[0]


def score(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """docs with `score`, the probability of label 1, from the whole of every text; null counts as empty, an empty text is
    one half of padding. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out, held, size = [], [], 0
            for t in batch:
                held.append((t or "").encode())
                size += len(held[-1])
                if size > AT_ONCE:
                    out.append(probabilities(shared.value, held))
                    held, size = [], 0
            if held:
                out.append(probabilities(shared.value, held))
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text)))


def op13_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(training_rows(docs, read(spark, sf_dir, "labels")))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
