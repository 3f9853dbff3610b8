"""Byte-level BPE over length-bucketed padded numpy matrices.

Distinct pieces of a batch are laid out as rows of token ids in matrices of equal width. Each round every row merges its
leftmost pair of minimum rank: all adjacent pairs are looked up in an open-addressed hash table of numpy arrays, the
winners are replaced and the rows are compacted by one cell. Rows without a pair that merges leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import read

NO_PAIR = np.iinfo(np.int32).max
CACHE_PIECES = 400_000  # pieces remembered by a task before it forgets them all
BATCH_CHARS = 1 << 20  # code points encoded together
MATRIX_CELLS = 1 << 21  # cells of one padded matrix; a longer single row is a matrix of its own
LONG = 4096  # bytes of a piece from which on a round merges all its pairs of the minimum rank
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


class PairTable:
    """(left, right) -> (rank, merged id): open addressing with linear probing over a power of two of slots."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.value = np.full(size, NO_PAIR, np.int32)
        key, val = (left.astype(np.int64) << 32) | right, merged.astype(np.int32)
        at = self._slot(key)
        self.probes = 1
        while len(key):  # each round the first comer of every free slot settles, the rest move on
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(key), bool)
            wins[first] = True
            wins &= free
            self.keys[at[wins]], self.value[at[wins]] = key[wins], val[wins]
            key, val, at = key[~wins], val[~wins], (at[~wins] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id, which is the rank too; NO_PAIR where the pair doesn't merge."""
        key = (left.astype(np.int64) << 32) | right
        at, out = self._slot(key), np.full(key.shape, NO_PAIR, np.int32)
        open_ = np.arange(key.size)
        flat, at, res = key.ravel(), at.ravel(), out.ravel()
        for _ in range(self.probes):
            found = self.keys[at[open_]]
            hit = found == flat[open_]
            res[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return res.reshape(key.shape)


class Encoder:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):  # every split of a token into two tokens merges to it, at its rank
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64))
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.said: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all rows of a padded matrix to the end: the matrix of ids, and each row's length."""
        final, final_length = rows.copy(), length.copy()
        alive = np.arange(len(rows))
        rank = self.pairs.get(rows[:, :-1], rows[:, 1:])
        rank[np.arange(rows.shape[1] - 1)[None, :] >= (length - 1)[:, None]] = NO_PAIR
        while len(alive) and rank.shape[1]:
            best = rank.argmin(1)
            value = rank[np.arange(len(rows)), best]
            over = value == NO_PAIR
            if over.any():
                final[alive[over], : rows.shape[1]], final_length[alive[over]] = rows[over], length[over]
                keep = ~over
                alive, rows, length, rank, best, value = alive[keep], rows[keep], length[keep], rank[keep], best[keep], value[keep]
                if not len(alive):
                    break
            r, width = np.arange(len(rows)), rows.shape[1]
            take = np.arange(width - 1)[None, :]
            take = take + (take > best[:, None])
            rows, rank = np.take_along_axis(rows, take, 1), np.take_along_axis(rank, np.minimum(take[:, : width - 2], width - 2), 1)
            rows[r, best] = value
            length = length - 1
            for at in (best - 1, best):  # only the two pairs beside the merged cell changed
                ok = np.flatnonzero((at >= 0) & (at < length - 1))
                rank[ok, at[ok]] = self.pairs.get(rows[ok, at[ok]], rows[ok, at[ok] + 1])
            end = np.flatnonzero(length - 1 < rank.shape[1])
            rank[end, length[end] - 1] = NO_PAIR
        final[alive, : rows.shape[1]], final_length[alive] = rows, length
        return final, final_length

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row to the end, as merge would.

        A round takes all pairs of the minimum rank from the left, as long as no merge makes a pair of a lower rank: then
        the leftmost-minimum order would take just these, one by one. Where one does, the round merges the leftmost only.
        """
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank):
            value = rank.min()
            if value == NO_PAIR:
                break
            at = np.flatnonzero(rank == value)
            run = np.cumsum(np.r_[True, np.diff(at) > 1])  # pairs that overlap their neighbours: every other one of a run
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            merged, new = self._merged(ids, rank, at, value)
            if len(at) > 1 and self._lowest(ids, new, at, value) < value:
                merged, new = self._merged(ids, rank, at[:1], value)
            ids, rank = merged, new
        return ids

    def _merged(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, value: int) -> tuple[np.ndarray, np.ndarray]:
        """ids with the pairs at `at` replaced by value, and the ranks of all pairs then."""
        stays = np.ones(len(ids), bool)
        stays[at + 1] = False
        out = ids.copy()
        out[at] = value
        out = out[stays]
        new = rank[stays[1:]] if len(rank) else rank  # a pair goes with the id on its right
        place = at - np.arange(len(at))
        left, right = place[place > 0] - 1, place[place < len(out) - 1]
        for side in (left, right):
            new[side] = self.pairs.get(out[side], out[side + 1])
        return out, new

    def _lowest(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, value: int) -> int:
        """The lowest rank beside a merged place, when all are merged and when only those left of it are."""
        place = at - np.arange(len(at))
        now = rank[np.r_[place[place > 0] - 1, place[place < len(rank)]]]
        right = ids[at[at + 2 < len(ids)] + 2]
        then = self.pairs.get(np.full(len(right), value, np.int32), right)
        return min(int(x.min()) for x in (now, then) if len(x)) if len(now) or len(then) else int(NO_PAIR)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. A piece that is itself a token is that token."""
        whole = list(map(self.ranks.get, pieces))
        out: list[list[int]] = [[w] for w in whole]  # type: ignore[misc]
        rest = sorted((k for k, w in enumerate(whole) if w is None), key=lambda k: len(pieces[k]))
        sizes = np.array([len(pieces[k]) for k in rest], np.int64)
        begin = 0
        while begin < len(rest):
            size = int(sizes[begin])
            if size >= LONG:
                out[rest[begin]] = self.merge_long(self.byte_id[np.frombuffer(pieces[rest[begin]], np.uint8)]).tolist()
                begin += 1
                continue
            width = next((w for w in WIDTHS if w >= size), size)
            end = min(int(np.searchsorted(sizes, width, "right")), begin + max(1, MATRIX_CELLS // width))
            group, length = rest[begin:end], sizes[begin:end]
            rows = np.zeros((len(group), width), np.int32)
            rows[np.arange(width)[None, :] < length[:, None]] = self.byte_id[np.frombuffer(b"".join([pieces[k] for k in group]), np.uint8)]
            ids, count = self.merge(rows, length)
            flat, ends = ids[np.arange(width)[None, :] < count[:, None]].tolist(), np.cumsum(count).tolist()
            at = 0
            for k, to in zip(group, ends):
                out[k] = flat[at:to]
                at = to
            begin = end
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Encode every piece that no earlier batch had, and decode its ids again."""
        seen = set().union(*texts)
        if len(self.said) + len(seen) > CACHE_PIECES:
            self.said.clear()
            self.back.clear()
        new = [p for p in seen if p not in self.said]
        ids, decimal = self.encode_pieces([p.encode() for p in new]), self.decimal
        self.said.update(zip(new, [" ".join([decimal[i] for i in x]) for x in ids]))
        self.back.update(zip(new, map(self.decode, ids)))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """For each text its ids as decimals joined by spaces, their number, and the bytes that the ids decode to."""
        pieces = [self.find(t) for t in texts]
        self.learn(pieces)
        for found in pieces:
            said = " ".join(map(self.said.__getitem__, found))
            yield said, said.count(" ") + bool(said), b"".join(map(self.back.__getitem__, found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def bounded(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of BATCH_CHARS or a little more together."""
    some: list[str] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with n_tokens and either ids (array<int>) or, for digest, ids_sha256 and decoded_sha256.

    The rank file at path is read by each executor's Python from its installed package; null text counts as empty, which
    has no tokens. Rows are independent, so any number of repeated, long or empty texts is fine. Input columns named
    like an added one are replaced.
    """

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Encoder.load(path, pattern)
        for batch in batches:
            rows = []
            for some in bounded(["" if t is None else t for t in batch]):
                for said, n, back in coder.encode_batch(some):
                    rows.append((n, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back).hexdigest()) if digest else (n, np.array(said.split(), np.int32)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids"])

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids array<int>"
    coded = F.pandas_udf(ids, kind)
    out = docs.withColumn("__bpe", coded(F.col(text)))
    return out.withColumns({c: F.col(f"__bpe.{c}") for c in (["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids"])}).drop("__bpe")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
