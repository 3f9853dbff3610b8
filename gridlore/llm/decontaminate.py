"""Benchmark decontamination by spaced seeds.

A fixed mask looks at some token positions of a window and ignores the others, so a window with substitutions at the
ignored positions still has the seed of the original. Seeds of the benchmark, taken in blocks of bounded size, meet the
seeds of every document position; each hit fixes a diagonal, on which the overlap around it is aligned and verified.
An item too short for that is cut into one piece more than the substitutions it may have, so one piece is intact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.llm.common import read, staged

#: Fixed masks: 1 is looked at, 0 is ignored. Each has weight 6; together they tolerate any two substitutions in 13 tokens.
MASKS = ("111111", "1110111", "1101011001", "11001010011", "1011000111", "110100100101")
MIN_OVERLAP, MIN_MATCH = 13, 0.8  # tokens of a verified overlap (a shorter item: all of it), and the share that are equal
SHORT = 12  # from here on no allowed substitutions escape all masks; items of fewer tokens have pieces instead
BLOCK_TOKENS = 1_000_000  # benchmark tokens broadcast at a time, in expectation: about 100 MB of seeds
LEAST_SEEN, MOST_SEEN = 20, 26  # bits of the bitmap before the seeds, in these bounds eight cells a seed
TOGETHER, GAP = 50_000, 12  # tokens whose seeds are looked up together; unknown words between texts, as wide as the widest mask
PAIRS, CELLS, FEW = 1 << 20, 1 << 22, 32  # (item, diagonal) pairs unpacked, and token pairs compared, at a time; so few pairs are verified one by one
DROP = 4  # an extension ends when it has lost so much against its best

WORD = re.compile(r"\w+")
MULTIPLIER = 0x9E3779B97F4A7C15


class Hasher:
    """64-bit hashes of a text's lower-cased words, words remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in [w for w in set(words) if w not in known]:
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed of every window, by its first position."""
    n = len(words) - len(mask) + 1
    out = np.full(max(0, n), int(mask, 2), np.uint64)
    if n > 0:
        for j in (j for j, c in enumerate(mask) if c == "1"):
            out = (out ^ words[j : j + n]) * np.uint64(MULTIPLIER)
            out ^= out >> np.uint64(31)
    return out


def pieces(n: int) -> list[tuple[int, str]]:
    """(start, solid mask) of adjoining pieces of an item of n tokens, one more than the substitutions it may have."""
    parts = sum(n - k >= MIN_MATCH * n for k in range(n))
    edges = [n * j // parts for j in range(parts + 1)] if n else []
    return [(a, "1" * (b - a)) for a, b in zip(edges, edges[1:])]


@dataclass(frozen=True)
class Block:
    """Seeds of some items: sorted hashes with the item and position of each, behind a bitmap of their leading bits."""

    masks: list[str]
    ids: list[int]
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray
    known: dict[str, int]  # the hash of each word of the items; other words can't be in a seed

    @classmethod
    def of(cls, items: list[tuple[int, str | None]]) -> Block:
        hasher = Hasher()
        ids, words = [i for i, _ in items], [hasher.of(t) for _, t in items]
        known = {w: h for (_, t), x in zip(items, words) for w, h in zip(WORD.findall((t or "").lower()), x.tolist())}
        found = [(seeds(w, m), k, 0) for k, w in enumerate(words) if len(w) >= SHORT for m in MASKS]
        cut = [(k, start, m) for k, w in enumerate(words) if len(w) < SHORT for start, m in pieces(len(w))]
        found += [(seeds(words[k][start : start + len(m)], m), k, start) for k, start, m in cut]
        masks = [*MASKS, *sorted({m for _, _, m in cut})]
        seed = np.concatenate([s for s, _, _ in found] or [np.empty(0, np.uint64)])
        item = np.concatenate([np.full(len(s), k, np.int32) for s, k, _ in found] or [np.empty(0, np.int32)])
        at = np.concatenate([np.arange(start, start + len(s), dtype=np.int32) for s, _, start in found] or [np.empty(0, np.int32)])
        order = np.argsort(seed, kind="stable")
        bits = min(MOST_SEEN, max(LEAST_SEEN, (8 * len(seed)).bit_length()))
        seen = np.zeros(1 << bits, bool)
        seen[(seed >> np.uint64(64 - bits)).astype(np.int64)] = True
        return cls(masks, ids, words, seed[order], item[order], at[order], seen, known)

    def words_of(self, text: str | None) -> np.ndarray:
        """Hashes of the text's words, 0 for those that no item has."""
        said = WORD.findall((text or "").lower())
        return np.fromiter(map(self.known.get, said, repeat(0)), np.uint64, len(said))

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item id, document start, item start, length, equal tokens): the longest verified overlap with each item."""
        return self.overlaps_of([words])[0]

    def overlaps_of(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int, int]]]:
        """overlaps of each of some texts, whose seeds are looked up together. Gaps of unknown words keep the texts apart."""
        size = np.array([len(x) + GAP for x in texts], np.int64)
        begin = np.cumsum(size) - size
        all_ = np.zeros(int(size.sum()), np.uint64)
        for p, x in zip(begin.tolist(), texts):
            all_[p : p + len(x)] = x
        usable, drop = all_ != 0, np.uint64(65 - len(self.seen).bit_length())
        hits: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        near: dict[int, dict[int, list[np.ndarray]]] = {}
        for mask in self.masks:
            n, look = len(all_) - len(mask) + 1, [j for j, c in enumerate(mask) if c == "1"]
            ok = usable[:n].copy()  # every mask starts with a position it looks at
            for j in look[1:]:
                ok &= usable[j : j + n]
            pos = np.flatnonzero(ok)
            s = np.full(len(pos), int(mask, 2), np.uint64)
            for j in look:  # as in seeds
                s = (s ^ all_[pos + j]) * np.uint64(MULTIPLIER)
                s ^= s >> np.uint64(31)
            some = self.seen[(s >> drop).astype(np.int64)]
            pos, s = pos[some], s[some]
            low, high = np.searchsorted(self.seed, s, "left"), np.searchsorted(self.seed, s, "right")
            pos, low, high = pos[low < high], low[low < high], high[low < high]
            if not len(pos):
                continue
            text = np.searchsorted(begin, pos, "right") - 1
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            for f, e in zip(first.tolist(), np.r_[first[1:], len(pos)].tolist()):
                t = int(text[f])
                self._gather(mask, pos[f:e] - begin[t], low[f:e], high[f:e], hits.setdefault(t, []), near.setdefault(t, {}))
        return [self._best(x, hits[t], near[t]) if t in hits else [] for t, x in enumerate(texts)]

    def _gather(self, mask: str, pos: np.ndarray, low: np.ndarray, high: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]], near: dict[int, list[np.ndarray]]) -> None:
        """Add a text's hits under one mask: positions with their range of seeds; diagonals (document position - item position) for short items."""
        if mask in MASKS:
            hits.append((pos, low, high))
            return
        n = high - low
        place = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        place, diagonal = place[order := np.argsort(self.item[place], kind="stable")], np.repeat(pos, n)[order]
        k, first = np.unique(self.item[place], return_index=True)
        for k_, d in zip(k.tolist(), np.split(diagonal - self.at[place], first[1:])):
            near.setdefault(k_, []).append(d)

    def _pairs(self, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, diagonals), each pair once a piece; hits of neighbouring positions under all masks share a piece."""
        pos, low, high = (np.concatenate(c) for c in zip(*hits))
        order = np.argsort(pos, kind="stable")
        pos, low, n = pos[order], low[order], (high - low)[order]
        ends = np.cumsum(n)
        cuts = np.unique(np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) + PAIRS, PAIRS), "right"))
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)]):
            if a == b:
                continue
            m = n[a:b]
            place = np.repeat(low[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())
            key = pd.unique((self.item[place].astype(np.int64) << 32) + (np.repeat(pos[a:b], m) - self.at[place] + (1 << 31)))
            yield key >> 32, (key & 0xFFFFFFFF) - (1 << 31)

    def _best(self, words: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]], near: dict[int, list[np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        best: dict[int, tuple[int, int, int, int]] = {}
        for item, diagonal in self._pairs(hits) if hits else ():
            for k, got in self._verified(words, item, diagonal):
                if k not in best or (got[3], got[2], -got[0]) > (best[k][3], best[k][2], -best[k][0]):
                    best[k] = got
        for k, some in near.items():
            best |= {k: got for got in whole(words, self.words[k], np.unique(np.concatenate(some)))}
        return [(self.ids[k], *got) for k, got in best.items()]

    def _verified(self, words: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
        """verified() of many pairs. Those with fewer equal tokens than any overlap needs are left out first, all in arrays."""
        if len(item) > FEW:
            size = self.size[item]
            begin, end = np.maximum(0, -diagonal), np.minimum(size, len(words) - diagonal)
            need = np.ceil(MIN_MATCH * np.minimum(MIN_OVERLAP, size) - 1e-9)
            order = np.argsort(end - begin, kind="stable")
            order = order[(end - begin)[order] >= need[order]]
            keep, a = [], 0
            while a < len(order):
                # pairs of like length make a matrix with little padding
                b = min(len(order), a + max(1, CELLS // int((end - begin)[order[min(len(order), a + 4096) - 1]])), a + 4096)
                at = order[a:b]
                n = (end - begin)[at]
                j = np.arange(n.max())
                inside = j < n[:, None]
                left = np.where(inside, (begin + diagonal)[at][:, None] + j, 0)
                right = np.where(inside, (self.first[item[at]] + begin[at])[:, None] + j, 0)
                same = ((words[left] == self.flat[right]) & inside).sum(1)
                keep.append(at[same >= need[at]])
                a = b
            at = np.concatenate(keep) if keep else np.empty(0, np.int64)
            item, diagonal = item[at], diagonal[at]
        for k, d in zip(item.tolist(), diagonal.tolist()):
            for got in verified(words, self.words[k], d):
                yield k, got

    @cached_property
    def size(self) -> np.ndarray:
        return np.array([len(w) for w in self.words], np.int64)

    @cached_property
    def first(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    @cached_property
    def flat(self) -> np.ndarray:
        return np.concatenate(self.words) if self.words else np.empty(0, np.uint64)


def whole(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The most equal, then leftmost of the diagonals on which enough of the whole item is equal, as from verified."""
    n = len(item)
    at = diagonals[(diagonals >= 0) & (diagonals + n <= len(words))]
    same = np.zeros(len(at), np.int64)
    for j in range(n):
        same += words[at + j] == item[j]
    k = int(np.argmax(same)) if len(at) else -1
    return [(int(at[k]), 0, n, int(same[k]))] if k >= 0 and same[k] >= MIN_MATCH * n else []


def verified(words: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, int, int, int]]:
    """Overlaps on one diagonal that are long and alike enough: (document start, item start, length, equal tokens).

    The whole item is one if enough of it is equal, and so is the longest run of equal tokens. Equal tokens count +1 and others -1; an overlap runs from where its sum starts to its highest point and ends where
    the sum has fallen DROP below that or to nothing.
    """
    begin, end = max(0, -diagonal), min(len(item), len(words) - diagonal)
    equal = words[begin + diagonal : end + diagonal] == item[begin:end]
    out, need = [], min(MIN_OVERLAP, len(item))
    if len(equal) == len(item) and equal.sum() >= MIN_MATCH * len(item):
        out.append((begin + diagonal, begin, len(item), int(equal.sum())))
    change = np.flatnonzero(np.diff(np.r_[False, equal, False]))
    first, size = change[::2], change[1::2] - change[::2]
    if len(size) and size.max() >= need:  # whatever lies before it
        at, n = int(first[size.argmax()]), int(size.max())
        out.append((begin + diagonal + at, begin + at, n, n))
    start, total, top, last = 0, 0, 0, -1

    def close() -> None:
        n = last - start + 1
        same = int(equal[start : last + 1].sum()) if n > 0 else 0
        if n >= need and same >= MIN_MATCH * n:
            out.append((begin + diagonal + start, begin + start, n, same))

    for k, e in enumerate(equal.tolist()):
        if total == 0 and not e:
            continue
        if total == 0:
            start, top, last = k, 0, k - 1
        total += 1 if e else -1
        if total > top:
            top, last = total, k
        if total == 0 or total <= top - DROP:
            close()
            total, top, last = 0, 0, -1
    if last >= 0:
        close()
    return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", tokens: int = BLOCK_TOKENS) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of about `tokens` tokens, by a hash of the text: each block is a bounded read.

    Equal texts are one item (the smallest id), so copies of one item don't fill a block.
    """
    words = F.size(F.split(F.col(text), r"\s+"))
    items = benchmark.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(F.col(item_id).cast("long")).alias("item_id"), F.max(words).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // tokens))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens, n_equal): each document with each item it overlaps, once.

    Positions count words. Null and empty texts overlap nothing. Rows of equal doc_id give the longest of their
    overlaps; null ids are reported with a null id.
    """
    context = docs.sparkSession.sparkContext
    # ids travel as text: pandas would turn a column of longs with a null into doubles
    body = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id string, item_id long, doc_start int, item_start int, n_tokens int, n_equal int"

    def scan(items: list[tuple[int, str | None]]) -> DataFrame:
        """What one block finds, written before the next block is read: one block is held at a time."""
        shared = context.broadcast(Block.of(items))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = shared.value
            for batch in batches:
                ids, some, size, rows = [], [], 0, []
                for d, t in zip(batch["doc_id"], batch["text"]):
                    ids.append(d), some.append(block.words_of(t))
                    size += len(some[-1])
                    if size >= TOGETHER:
                        rows += [(i, *got) for i, found in zip(ids, block.overlaps_of(some)) for got in found]
                        ids, some, size = [], [], 0
                rows += [(i, *got) for i, found in zip(ids, block.overlaps_of(some)) for got in found]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])

        found = staged(body.mapInPandas(run, schema), "overlaps")
        shared.unpersist()
        return found

    found = reduce(DataFrame.unionByName, [scan(b) for b in blocks(benchmark, tokens=tokens)]).withColumn("doc_id", F.col("doc_id").cast("long"))
    best = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n_equal"), F.desc("n_tokens"), "doc_start", "item_start"))
    return found.withColumn("rank", best).where("rank = 1").drop("rank")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the documents that overlap an item; rows of equal id, null too, go together."""
    gone = overlaps(docs, benchmark, text, doc_id).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__gone")), "left_anti")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
