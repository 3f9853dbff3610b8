"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes covering it also starts in a document with a smaller id. The work is dealt out
by content: each window of `length` bytes belongs to the smallest hash among its short grams (its key), so equal windows
share a key wherever they are. A run of windows with one key is a fragment. Fragments whose key is in one document only
are left behind; the others meet in buckets by key. In a bucket the distinct fragments form one text; intervals of its
suffix array that share a prefix are extended backwards by one byte a level, breadth first, so common prefixes come out
by increasing length, and the expansion ends at `length`. Each final interval is a repeated string, with its smallest
document.

What travels is packed by task block, so the rows between the steps are a pack for each block and bucket, never one for
each document and bucket. A bucket that outgrows its limit, because one gram is in a large share of all documents, is
dealt again: its rare keys by key, its frequent keys window by window, by the hash of the whole window, each distinct
window once a block. Equal windows still meet, and no task holds all contents of a gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import read, release, staged

LENGTH, GRAM = 50, 16
ORDER = 64  # bytes by which suffixes are sorted; at least the length
NO_ID = -(2**63)
BLOCK_BYTES = 16 << 20  # text whose fragments a task gathers before it writes them
BUCKET_BYTES = 4 << 20  # text of the input for each bucket of contents; larger executors take larger buckets, in fewer packs
BUCKET_LIMIT = 64 << 20  # bytes of contents in a bucket from which on it is dealt again
SHRINKS = 2  # bytes of contents for each of a pack, about
PIECE_BYTES = 1 << 24  # windows of a document hashed together
MIX = 0x9E3779B97F4A7C15


def shrunk(parts: Iterable[bytes]) -> bytes:
    """What a pack is when it travels; shuffles compress less."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def grown(pack: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(pack)


def power(n: int) -> np.uint64:
    return np.uint64(pow(MIX, n, 1 << 64))


def fragments(data: bytes, length: int = LENGTH, contents: bool = False) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their smallest gram: (gram, left, right, first window, windows).

    gram is the hash of that gram, which depends on the window alone, so equal windows have equal grams in every
    document. left and right hash the gram with the bytes before and after it. A window reaches far enough to one side
    that fragments sharing a window share left or right; 0 stands for a side that the document ends too soon for.
    With contents, left is the hash of the fragment's bytes instead.
    """
    some = [_fragments(data[k : k + PIECE_BYTES + length - 1], k, length, contents) for k in range(0, max(1, len(data) - length + 1), PIECE_BYTES)]
    return tuple(np.concatenate(x) for x in zip(*some))


def _fragments(data: bytes, offset: int, length: int, contents: bool) -> tuple[np.ndarray, ...]:
    n = len(data)
    if n < length:
        return *(np.empty(0, np.uint64) for _ in range(3)), *(np.empty(0, np.int32) for _ in range(2))
    raw = np.frombuffer(data, np.uint8)
    h, k = raw.astype(np.uint64) + np.uint64(1), 1
    while k < GRAM:  # hashes of twice as many bytes
        h = h[:-k] * power(k) + h[k:]
        h ^= h >> np.uint64(31)
        k *= 2
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(29)
    low = (h & ~np.uint64(PIECE_BYTES * 2 - 1)) | np.arange(len(h), dtype=np.uint64)  # ties go to the leftmost gram
    k, width = 1, length - GRAM + 1
    while k < width:
        step = min(k, width - k)
        low = np.minimum(low[:-step], low[step:])
        k += step
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    windows = np.diff(np.r_[first, len(low)])
    at = (low[first] & np.uint64(PIECE_BYTES * 2 - 1)).astype(np.int64)
    gram = h[at]
    if contents:
        left, right = content_hashes(raw, first, windows + length - 1), np.empty(len(first), np.uint64)
    else:
        reach, last = min(GRAM, width // 2), len(h) - 1
        left = np.where(at >= reach, gram * power(5) + h[np.maximum(at - reach, 0)], np.uint64(0))
        right = np.where(at + reach <= last, gram * power(7) + h[np.minimum(at + reach, last)], np.uint64(0))
        left ^= left >> np.uint64(32)
        right ^= right >> np.uint64(32)
    return gram, left, right, (first + offset).astype(np.int32), windows.astype(np.int32)


@lru_cache(maxsize=8)
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number a byte value, and powers of an odd number and of its inverse, up to n."""
    odd = np.uint64(MIX)
    forth, back = np.full(n, odd), np.full(n, np.uint64(pow(MIX, -1, 1 << 64)))
    forth[:1] = back[:1] = 1
    return np.random.default_rng(2).integers(0, 2**64, 256, np.uint64), np.cumprod(forth), np.cumprod(back)


def content_hashes(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the strings raw[first : first + size], from sums of weighted bytes."""
    value, forth, back = powers(1 << int(len(raw)).bit_length())
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value[raw] * forth[: len(raw)], out=total[1:])
    h = (total[first + size] - total[first]) * back[first] + size.astype(np.uint64) * np.uint64(MIX)
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


PARTS = "bucket int, entries binary, left binary, right binary, told boolean"


def starts(*columns: np.ndarray) -> np.ndarray:
    """First place of each run of equal rows."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def pack(bucket: int, doc: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, ordinal: np.ndarray, told: bool) -> tuple:
    """Entries in order of their document, with each document written once."""
    first = starts(doc, row)
    count = np.diff(np.r_[first, len(doc)]).astype(np.int32)
    runs = [doc[first].tobytes(), row[first].tobytes(), count.tobytes(), ordinal.astype(np.int32).tobytes()]
    return bucket, shrunk([np.array([len(first), len(doc)], np.int64).tobytes(), *runs]), left.astype(np.uint32).tobytes(), right.astype(np.uint32).tobytes(), told


def unpack(packs: Iterable[bytes]) -> tuple[np.ndarray, ...]:
    """doc, row and ordinal of all entries."""
    doc, row, ordinal = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for p in map(grown, packs):
        n, m = np.frombuffer(p, np.int64, 2).tolist()
        count = np.frombuffer(p, np.int32, n, 16 + 16 * n)
        doc.append(np.repeat(np.frombuffer(p, np.int64, n, 16), count))
        row.append(np.repeat(np.frombuffer(p, np.int64, n, 16 + 8 * n), count))
        ordinal.append(np.frombuffer(p, np.int32, m, 16 + 20 * n))
    return np.concatenate(doc), np.concatenate(row), np.concatenate(ordinal)


def several(key: np.ndarray, doc: np.ndarray, told: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is its key in two documents or more (or told to be), and is it the first of its key. Key 0 is none."""
    many, lead = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        first = starts(key[order])
        two = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
        if told is not None:
            two |= np.logical_or.reduceat(told[order], first)
        many[order] = np.repeat(two, np.diff(np.r_[first, len(key)]))
        lead[order[first]] = True
    return many & (key != 0), lead & (key != 0)


def by_group(doc: np.ndarray, row: np.ndarray, ordinal: np.ndarray, groups: int) -> pd.DataFrame:
    """One row a group of documents with their ordinals packed."""
    group = ((doc.view(np.uint64) * np.uint64(MIX) ^ row.view(np.uint64)) * np.uint64(MIX) >> np.uint64(32)) % np.uint64(groups)
    order = np.lexsort((row, doc, group))
    doc, row, ordinal, group = doc[order], row[order], ordinal[order].astype(np.int32), group[order]
    begin = starts(group)
    none = np.empty(0, np.uint32)
    rows = [pack(int(group[b]), doc[b:e], row[b:e], none, none, ordinal[b:e], True)[:2] for b, e in zip(begin.tolist(), np.r_[begin[1:], len(doc)].tolist())]
    return pd.DataFrame(rows, columns=["group", "entries"])


def ordinals_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a document with its distinct ordinals."""
    doc, row, ordinal = unpack(pdf["entries"])
    order = np.lexsort((ordinal, row, doc))
    order = order[starts(doc[order], row[order], ordinal[order])]
    doc, row, ordinal = doc[order], row[order], ordinal[order]
    first = starts(doc, row)
    return pd.DataFrame({"doc": doc[first], "row": row[first], "ordinals": [x.tobytes() for x in np.split(ordinal, first[1:])] if len(doc) else []})


def shared_ordinals(docs: DataFrame, buckets: int, groups: int, length: int) -> DataFrame:
    """(doc, row, ordinals): the fragments of each document that share left or right with another document, one row a document.

    Entries are packed by task block and bucket. What several documents of a block share is settled there and told once
    a block (a negative ordinal: bit 0 for left, bit 1 for right), so a passage of most documents costs an entry a
    block, not one a document.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> pd.DataFrame:
            gram, left, right, doc, row, ordinal = (np.concatenate(x) for x in gathered)
            (many_l, lead_l), (many_r, lead_r) = several(left, doc), several(right, doc)
            settled = many_l | many_r
            out = [pack(int(doc[0] % buckets), doc[settled], row[settled], left[:0], right[:0], ordinal[settled], True)]
            send = ~settled | lead_l | lead_r
            ordinal = np.where(settled, -(many_l.astype(np.int32) + 2 * many_r), ordinal)
            bucket = (gram % np.uint64(buckets)).astype(np.int32)
            bucket[~send] = buckets
            order = np.argsort(bucket, kind="stable")
            first = starts(bucket[order])
            for at in np.split(order, first[1:]):  # the buckets that the block has
                if len(at) and bucket[at[0]] < buckets:
                    out.append(pack(int(bucket[at[0]]), doc[at], row[at], left[at], right[at], ordinal[at], False))
            return pd.DataFrame(out, columns=["bucket", "entries", "left", "right", "told"])

        gathered: list[list[np.ndarray]] = [[] for _ in range(6)]
        size, seen = 0, set()
        for batch in batches:
            for doc, row, text in zip(batch["doc"], batch["row"], batch["text"]):
                if (doc, row) in seen:  # repeated rows
                    continue
                seen.add((doc, row))
                data = text.encode()
                gram, left, right, _, _ = fragments(data, length)
                n = len(gram)
                if n:
                    for held, x in zip(gathered, (gram, left, right, np.full(n, doc, np.int64), np.full(n, row, np.int64), np.arange(n, dtype=np.int32))):
                        held.append(x)
                size += len(data)
                if size >= BLOCK_BYTES and gathered[0]:
                    yield flush()
                    gathered, size, seen = [[] for _ in range(6)], 0, set()
        if gathered[0]:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        told = pdf["told"].to_numpy(bool)
        known_doc, known_row, known = unpack(pdf["entries"][told])
        doc, row, ordinal = unpack(pdf["entries"][~told])
        left, right = (np.frombuffer(b"".join(pdf[c][~told]), np.uint32) for c in ("left", "right"))
        flags = np.where(ordinal < 0, -ordinal, 0)
        many = several(left, doc, (flags & 1) > 0)[0] | several(right, doc, (flags & 2) > 0)[0]
        keep = many & (ordinal >= 0)
        return by_group(np.r_[known_doc, doc[keep]], np.r_[known_row, row[keep]], np.r_[known, ordinal[keep]], groups)

    found = docs.mapInPandas(scan, PARTS).groupBy("bucket").applyInPandas(lambda pdf: meet(pdf), "group int, entries binary")
    return found.groupBy("group").applyInPandas(lambda pdf: ordinals_of(pdf), "doc long, row long, ordinals binary")


FOUND = "block long, bucket int, contents binary, occurrences binary"


def occurrences(docs: DataFrame, shared: DataFrame, length: int, buckets: int) -> DataFrame:
    """(block, bucket, contents, occurrences) of the shared fragments: a pack for each task block and bucket.

    contents holds the distinct contents of the block, each with its smallest document there; occurrences says where
    they are: document, row, first window and the number of the content in the pack.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def flush() -> pd.DataFrame:
            key, content_hash, first, windows, doc, row, text = (np.concatenate(x) for x in gathered)
            order = np.lexsort((content_hash, key, key % np.uint64(buckets)))
            lead = starts(key[order], content_hash[order])
            number = np.empty(len(key), np.int64)
            number[order] = np.repeat(np.arange(len(lead)), np.diff(np.r_[lead, len(key)]))
            low, most, head = np.minimum.reduceat(doc[order], lead), np.maximum.reduceat(doc[order], lead), order[lead]
            size = windows[head].astype(np.int64) + length - 1
            contents = [texts[t][f : f + n] for t, f, n in zip(text[head].tolist(), first[head].tolist(), size.tolist())]
            place = (key[head] % np.uint64(buckets)).astype(np.int64)
            begin = starts(place)
            edge = np.r_[begin, len(head)]
            mine = (key % np.uint64(buckets)).astype(np.int64)
            told = np.argsort(mine, kind="stable")  # in order of documents inside a bucket
            cuts = np.searchsorted(mine[told], np.r_[place[begin], buckets])
            rows = []
            for j, (p, q) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
                at = told[cuts[j] : cuts[j + 1]]
                packed = pack_contents((key[head[p:q]] >> np.uint64(32)).astype(np.int64), low[p:q], (most > low)[p:q].astype(np.int64), contents[p:q])
                rows.append((block, int(place[p]), packed, pack_occurrences(doc[at], row[at], first[at], number[at] - p)))
            return pd.DataFrame(rows, columns=["block", "bucket", "contents", "occurrences"])

        gathered: list[list[np.ndarray]] = [[] for _ in range(7)]
        texts: list[bytes] = []
        size, seen = 0, set()
        for batch in batches:
            for doc, row, text, ordinals in zip(batch["doc"], batch["row"], batch["text"], batch["ordinals"]):
                if (doc, row) in seen:
                    continue
                seen.add((doc, row))
                data = text.encode()
                gram, content_hash, _, first, n = fragments(data, length, contents=True)
                at = np.frombuffer(ordinals, np.int32)
                at = at[at < len(gram)]
                if len(at):
                    for held, x in zip(gathered, (gram[at], content_hash[at], first[at], n[at], np.full(len(at), doc, np.int64), np.full(len(at), row, np.int64), np.full(len(at), len(texts), np.int32))):
                        held.append(x)
                    texts.append(data)
                    size += len(data)
                if size >= BLOCK_BYTES:
                    yield flush()
                    gathered, texts, size, seen, block = [[] for _ in range(7)], [], 0, set(), block + 1
        if size:
            yield flush()

    return docs.join(shared, ["doc", "row"]).select("doc", "row", "text", "ordinals").mapInPandas(cut, FOUND)


def pack_contents(key: np.ndarray, low: np.ndarray, many: np.ndarray, contents: list[bytes]) -> bytes:
    size = np.array([len(c) for c in contents], np.int64)
    return shrunk([np.array([len(contents)], np.int64).tobytes(), *(x.tobytes() for x in (key, low, many, size)), *contents])


def content_heads(pack: bytes) -> np.ndarray:
    """Rows key, low, many, size of a grown pack. Half a key is enough: two keys that agree there are solved together."""
    n = int(np.frombuffer(pack, np.int64, 1)[0])
    return np.frombuffer(pack, np.int64, 4 * n, 8).reshape(4, n)


def content_bytes(pack: bytes) -> list[bytes]:
    size = content_heads(pack)[3]
    end = 8 + 32 * len(size) + np.cumsum(size)
    return [pack[e - n : e] for e, n in zip(end.tolist(), size.tolist())]


def pack_occurrences(doc: np.ndarray, row: np.ndarray, first: np.ndarray, number: np.ndarray) -> bytes:
    lead = starts(doc, row)
    count = np.diff(np.r_[lead, len(doc)]).astype(np.int32)
    return shrunk([np.array([len(lead), len(doc)], np.int64).tobytes(), *(x.tobytes() for x in (doc[lead], row[lead], count, first.astype(np.int32), number.astype(np.int32)))])


def unpack_occurrences(pack: bytes) -> tuple[np.ndarray, ...]:
    pack = grown(pack)
    n, m = np.frombuffer(pack, np.int64, 2).tolist()
    doc, row = np.frombuffer(pack, np.int64, n, 16), np.frombuffer(pack, np.int64, n, 16 + 8 * n)
    count = np.frombuffer(pack, np.int32, n, 16 + 16 * n)
    first, number = (np.frombuffer(pack, np.int32, m, 16 + 20 * n + 4 * m * k) for k in (0, 1))
    return np.repeat(doc, count), np.repeat(row, count), first, number


DEALT = "block long, bucket int, part int, contents binary, origin binary"


def dealt(found: DataFrame, length: int, limit: int) -> DataFrame:
    """(block, bucket, part, contents, origin): packs as they are, and those of overfull buckets cut into parts.

    In an overfull bucket, keys of little content go to a part by their hash. A key of much content is cut into its
    windows; each goes to a part by its own hash, distinct windows once a pack. origin lists (content of the pack,
    first window, windows, content of the part) and stays with the block; null: contents are as they were.
    """
    plain = found.select("block", "bucket", F.lit(0).alias("part"), "contents", F.lit(None).cast("binary").alias("origin"))
    over = staged(found.groupBy("bucket").agg(F.sum(F.octet_length("contents") * SHRINKS).alias("bytes")).where(F.col("bytes") > limit), "overfull-buckets")
    if over.isEmpty():
        return plain

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bucket, contents in zip(pdf["bucket"], pdf["contents"]):
                head = content_heads(grown(contents))
                order = np.argsort(head[0], kind="stable")
                first = starts(head[0][order])
                yield pd.DataFrame({"key": head[0][order][first], "bytes": np.add.reduceat(head[3][order] + 32, first)}).assign(bucket=bucket)

    heavy = found.join(over.select("bucket"), "bucket").select("bucket", "contents").mapInPandas(weigh, "key long, bytes long, bucket int")
    heavy = heavy.groupBy("bucket", "key").agg(F.sum("bytes").alias("bytes"))
    is_hot = F.col("bytes") > limit // 8  # at most 8 keys for each limit of bytes
    growth = (length + 48) // 4  # bytes of a window that travels alone against those it adds to a content, about
    plan = heavy.groupBy("bucket").agg(
        F.collect_list(F.when(is_hot, F.col("key"))).alias("hot"), F.ceil(F.coalesce(F.sum(F.when(~is_hot, F.col("bytes"))), F.lit(0)) * 2 / limit + 1).cast("int").alias("n_cold"),
        F.ceil(F.coalesce(F.sum(F.when(is_hot, F.col("bytes"))), F.lit(0)) * growth / limit + 1).cast("int").alias("n_hot"),
    )
    plan = staged(plan, "overfull-plan")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, bucket, pack, hot, n_cold, n_hot in zip(pdf["block"], pdf["bucket"], pdf["contents"], pdf["hot"], pdf["n_cold"], pdf["n_hot"]):
                pack = grown(pack)
                head, contents = content_heads(pack), content_bytes(pack)
                is_hot = np.isin(head[0], np.array(hot, np.int64))
                cold = np.flatnonzero(~is_hot)
                part = ((head[0].astype(np.uint64) * np.uint64(MIX) >> np.uint64(32)) % np.uint64(n_cold)).astype(np.int64)
                rows = []
                for p in np.unique(part[cold]).tolist():
                    at = cold[part[cold] == p]
                    windows = head[3][at] - length + 1
                    origin = np.column_stack([at, np.zeros_like(at), windows, np.arange(len(at))]).astype(np.int32)
                    rows.append((block, bucket, 1 + p, pack_contents(*(head[k][at] for k in range(3)), [contents[k] for k in at.tolist()]), origin.tobytes()))
                at = np.flatnonzero(is_hot)
                if len(at):
                    n = head[3][at] - length + 1
                    content, window = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    raw = np.frombuffer(b"".join([contents[k] for k in at.tolist()]), np.uint8)
                    begin = np.repeat(np.cumsum(head[3][at]) - head[3][at], n) + window
                    h = window_hashes(raw, begin, length).view(np.int64)
                    order = np.lexsort((h, head[0][content]))
                    first = starts(head[0][content][order], h[order])
                    low, most = np.minimum.reduceat(head[1][content][order], first), np.maximum.reduceat(head[1][content][order], first)
                    many = np.maximum.reduceat(head[2][content][order], first) | (most > low)
                    lead = order[first]
                    where = ((h[lead].view(np.uint64) >> np.uint64(20)) % np.uint64(n_hot)).astype(np.int64)
                    unique = np.repeat(np.arange(len(lead)), np.diff(np.r_[first, len(order)]))
                    for p in np.unique(where).tolist():
                        chosen = np.flatnonzero(where == p)
                        mine = where[unique] == p
                        inside = np.searchsorted(chosen, unique[mine])
                        origin = np.column_stack([content[order][mine], window[order][mine], np.ones(mine.sum(), np.int64), inside]).astype(np.int32)
                        strings = [raw[b : b + length].tobytes() for b in begin[lead[chosen]].tolist()]
                        rows.append((block, bucket, 1 + n_cold + p, pack_contents(head[0][content][lead[chosen]], low[chosen], many[chosen], strings), origin.tobytes()))
                yield pd.DataFrame(rows, columns=["block", "bucket", "part", "contents", "origin"])

    again = found.join(plan, "bucket").select("block", "bucket", "contents", "hot", "n_cold", "n_hot").mapInPandas(deal, DEALT)
    return staged(plain.join(over.select("bucket"), "bucket", "left_anti").select("block", "bucket", "part", "contents", "origin").unionByName(again), "dealt-again")


def window_hashes(raw: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of `length` bytes from each of begin."""
    h = np.zeros(len(begin), np.uint64)
    for j in range(length):
        h = (h ^ raw[begin + j]) * np.uint64(MIX)
        h ^= h >> np.uint64(31)
    return h


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Rotations of a circular text sorted by their first ORDER bytes, by doubling from eight bytes."""
    n, rank = len(text), np.zeros(len(text), np.uint64)
    for j in range(8):
        rank = (rank << np.uint64(8)) | np.roll(text, -j)
    order = np.argsort(rank)
    width = 8
    while True:
        ordered = rank[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]).astype(np.uint64)
        if width >= ORDER or int(rank[order[-1]]) == n - 1:
            return order.astype(np.int32)
        rank = rank * np.uint64(n) + np.roll(rank, -width)
        order = np.argsort(rank)
        width *= 2


def intervals(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """The number of the interval of each place of the suffix order, intervals sharing `length` bytes.

    Breadth-first backward extension: places that follow one byte and whose next bytes lie in one interval of the last
    level form an interval of this level. The boundaries that appear at a level are where the common prefix is one less.
    """
    before = text[order - 1]  # the transform
    back = np.argsort(before, kind="stable").astype(np.int32)  # place -> place of the suffix one byte on
    byte = before[back]
    cut = np.r_[True, byte[1:] != byte[:-1]]
    number = np.zeros(len(text), np.int32)
    live = np.arange(len(text), dtype=np.int32)  # places in intervals of two or more; single ones extend no further
    for _ in range(length):
        if not len(live):
            break
        got = number[back[live]]
        fresh = cut[live]
        fresh[1:] |= (got[1:] != got[:-1]) | (live[1:] != live[:-1] + 1)
        fresh[:1] = True
        first = np.flatnonzero(fresh)
        number[live] = np.repeat(live[first], np.diff(np.r_[first, len(live)]))
        single = fresh & np.r_[fresh[1:], True]
        live = live[~single]
    return number


def smallest_documents(contents: list[bytes], low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(content, smallest document) of each window of distinct contents, over all that have the window."""
    size = np.array([len(c) for c in contents])
    text = np.frombuffer(b"\xff".join(contents) + b"\xff" * ORDER, np.uint8)  # 0xff is in no UTF-8 text
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]
    order = suffix_order(text)
    number = intervals(text, order, length)
    at = np.full(len(text), np.iinfo(np.int64).max)
    windows = size - length + 1
    content = np.repeat(np.arange(len(contents)), windows)
    place = np.repeat(begin - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
    at[place] = low[content]
    first = starts(number)
    least = np.minimum.reduceat(at[order], first)
    at[order] = np.repeat(least, np.diff(np.r_[first, len(text)]))
    return content, at[place]


def solve(packs: list[bytes], length: int) -> list[bytes]:
    """For each pack its runs, packed as (content, first window, windows, smallest document), where they remove anything.

    A content whose key no other content has shares no window with another content: it would end in intervals of its
    own and is left out of the transform.
    """
    packs = [grown(p) for p in packs]
    heads = [content_heads(p) for p in packs]
    key, low, many, size = np.concatenate(heads, axis=1)
    content_hash = np.concatenate([content_hashes(np.frombuffer(p, np.uint8, -1, 8 + 32 * h.shape[1]), np.cumsum(h[3]) - h[3], h[3]) for p, h in zip(packs, heads)])
    order = np.lexsort((content_hash, key))
    first = starts(key[order], content_hash[order])
    distinct = np.empty(len(key), np.int64)
    distinct[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    least, most, lead = np.minimum.reduceat(low[order], first), np.maximum.reduceat(low[order], first), order[first]
    use = (np.maximum.reduceat(many[order], first) > 0) | (most > least)
    keys = key[lead]
    same = keys[1:] == keys[:-1]
    meets = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    content, smallest = np.arange(len(lead)), least.copy()  # runs: (content, windows, smallest document)
    begin, windows = np.zeros(len(lead), np.int64), size[lead] - length + 1
    if len(meets):
        edge = np.r_[0, np.cumsum([h.shape[1] for h in heads])]
        texts: list[bytes | None] = [None] * len(key)
        wanted = np.zeros(len(key), bool)
        wanted[lead[meets]] = True
        for j, p in enumerate(packs):
            at = np.flatnonzero(wanted[edge[j] : edge[j + 1]])
            end = 8 + 32 * heads[j].shape[1] + np.cumsum(heads[j][3])
            for k, e, n in zip((at + edge[j]).tolist(), end[at].tolist(), heads[j][3][at].tolist()):
                texts[k] = p[e - n : e]
        told, window_least = smallest_documents([texts[k] for k in lead[meets].tolist()], least[meets], length)
        use[meets[told[window_least < least[meets][told]]]] = True
        cut = starts(told, window_least)
        inside = np.arange(len(told)) - np.searchsorted(told, told)
        alone = np.setdiff1d(content, meets, assume_unique=True)
        content, smallest = np.r_[alone, meets[told[cut]]], np.r_[least[alone], window_least[cut]]
        begin, windows = np.r_[begin[alone], inside[cut]], np.r_[windows[alone], np.diff(np.r_[cut, len(told)])]
        order = np.argsort(content, kind="stable")
        content, smallest, begin, windows = content[order], smallest[order], begin[order], windows[order]
    edge = np.searchsorted(content, np.arange(len(lead) + 1))
    out, done = [], 0
    for h in heads:
        mine = distinct[done : done + h.shape[1]]
        done += h.shape[1]
        n = np.where(use[mine], edge[mine + 1] - edge[mine], 0)
        at = np.repeat(edge[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(pack_runs(np.repeat(np.arange(len(mine)), n), begin[at], windows[at], smallest[at]))
    return out


def pack_runs(content: np.ndarray, begin: np.ndarray, windows: np.ndarray, least: np.ndarray) -> bytes:
    return shrunk([content.astype(np.int32).tobytes(), begin.astype(np.int32).tobytes(), windows.astype(np.int32).tobytes(), least.astype(np.int64).tobytes()])


def unpack_runs(pack: bytes) -> tuple[np.ndarray, ...]:
    pack = grown(pack)
    n = len(pack) // 20
    return *(np.frombuffer(pack, np.int32, n, 4 * n * k) for k in range(3)), np.frombuffer(pack, np.int64, n, 12 * n)


def repeated(packs: DataFrame, length: int) -> DataFrame:
    """(block, bucket, part, runs): the answer to each pack of dealt."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["block", "bucket", "part"]].assign(runs=solve(pdf["contents"].tolist(), length))

    return packs.select("block", "bucket", "part", "contents").groupBy("bucket", "part").applyInPandas(lambda pdf: answer(pdf), "block long, bucket int, part int, runs binary")


def removed_spans(found: DataFrame, packs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(doc, row, spans): packed [begin, end) pairs of bytes that go, overlapping at fragment edges.

    A block's occurrences meet the answers to its packs; a group is what one task block had.
    """

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        docs, rows, pairs = [], [], []
        for _, bucket in pdf.groupby("bucket"):
            kind = bucket["kind"].to_numpy()
            origins = {int(p): np.frombuffer(x, np.int32).reshape(-1, 4) for p, x in zip(bucket["part"][kind == 2], bucket["data"][kind == 2])}
            told = [[] for _ in range(4)]
            for part, data in zip(bucket["part"][kind == 1], bucket["data"][kind == 1]):
                content, begin, windows, least = unpack_runs(data)
                if int(part) in origins:  # back to the contents that the block has
                    origin = origins[int(part)]
                    origin = origin[np.argsort(origin[:, 3], kind="stable")]
                    a, b = np.searchsorted(origin[:, 3], content, "left"), np.searchsorted(origin[:, 3], content, "right")
                    at = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
                    run = np.repeat(np.arange(len(content)), b - a)
                    content, begin, windows, least = origin[at, 0], origin[at, 1] + begin[run], windows[run], least[run]
                for held, x in zip(told, (content, begin, windows, least)):
                    held.append(x)
            if not told[0]:
                continue
            content, begin, windows, least = (np.concatenate(x) for x in told)
            order = np.argsort(content, kind="stable")
            content, begin, windows, least = content[order], begin[order], windows[order], least[order]
            for data in bucket["data"][kind == 0]:
                doc, row, first, number = unpack_occurrences(data)
                a, b = np.searchsorted(content, number, "left"), np.searchsorted(content, number, "right")
                at = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
                mine = np.repeat(np.arange(len(number)), b - a)
                goes = least[at] < doc[mine]
                at, mine = at[goes], mine[goes]
                start = first[mine] + begin[at]
                docs.append(doc[mine]), rows.append(row[mine]), pairs.append(np.column_stack([start, start + windows[at] + length - 1]).astype(np.int32))
        if not docs:
            return pd.DataFrame({"doc": [], "row": [], "spans": []})
        doc, row, pair = np.concatenate(docs), np.concatenate(rows), np.concatenate(pairs)
        order = np.lexsort((pair[:, 0], row, doc))
        doc, row, pair = doc[order], row[order], pair[order]
        first = starts(doc, row)
        return pd.DataFrame({"doc": doc[first], "row": row[first], "spans": [union_of(x).tobytes() for x in np.split(pair, first[1:])] if len(doc) else []})

    said = found.select("block", "bucket", F.lit(0).alias("part"), F.lit(0).alias("kind"), F.col("occurrences").alias("data"))
    said = said.unionByName(runs.select("block", "bucket", "part", F.lit(1).alias("kind"), F.col("runs").alias("data")))
    said = said.unionByName(packs.where(F.col("origin").isNotNull()).select("block", "bucket", "part", F.lit(2).alias("kind"), F.col("origin").alias("data")))
    out = said.groupBy("block").applyInPandas(lambda pdf: spans(pdf), "doc long, row long, spans binary")
    return out.groupBy("doc", "row").agg(F.max("spans").alias("spans"))  # repeated rows of two blocks have equal spans


def union_of(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans of ordered ones, touching ones joined."""
    s = spans.astype(np.int64)
    reach = np.maximum.accumulate(s[:, 1])
    first = np.flatnonzero(np.r_[True, s[1:, 0] > reach[:-1]])
    return np.column_stack([s[first, 0], reach[np.r_[first[1:] - 1, len(s) - 1]]])


def kept_bytes(data: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """The bytes that stay, the number that go, and the number of runs that go."""
    if spans is None or not len(spans):
        return data, 0, 0
    gone = np.frombuffer(spans, np.int64).reshape(-1, 2)
    edges = [0, *gone.ravel().tolist(), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return kept, len(data) - len(kept), len(gone)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", digest: bool = False, bucket_bytes: int = BUCKET_BYTES, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and kept (binary) or, for digest, kept_sha256: one row for each row of docs.

    Null text counts as empty; texts shorter than `length` keep all. Rows of equal id are one document, so they don't
    remove from each other; a null id is below all others. length must be from GRAM + 1 to ORDER - 1. Other columns are
    not read.
    """
    spark = docs.sparkSession
    body = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = body.withColumn("row", F.xxhash64("text"))
    total = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))  # by the size of the input alone
    halves = -(-buckets // 2)
    shared = staged(shared_ordinals(body, halves, halves, length), "shared-fragments")
    release(spark)
    found = staged(occurrences(body, shared, length, buckets), "fragments")
    release(spark, shared)
    packs = dealt(found, length, bucket_limit)
    runs = staged(repeated(packs, length), "repeats")
    release(spark)
    gone = staged(removed_spans(found, packs, runs, length), "removed")
    release(spark, found, runs)

    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for t, s in zip(texts, spans):
                data = t.encode()
                kept, n, runs = kept_bytes(data, s)
                rows.append((len(data), n, runs, hashlib.sha256(kept).hexdigest() if digest else kept))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    udf = F.pandas_udf(apply, f"n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    out = body.join(gone, ["doc", "row"], "left").select("doc", udf("text", "spans").alias("r")).select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "r.*")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def op5_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


OP5_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS k FROM d)
), m AS (
  SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING max(doc_id) > min(doc_id)
), g AS (
  SELECT w.doc_id, w.k FROM w JOIN m ON w.s = m.s WHERE w.doc_id > m.low
), f AS (
  SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM g
), i AS (
  SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM f
), gone AS (
  SELECT doc_id, min(k) AS b, max(k) + 50 AS e FROM i GROUP BY doc_id, island
), edges AS (
  SELECT doc_id, b AS upto, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS since FROM gone
  UNION ALL
  SELECT d.doc_id, length(d.h) // 2, coalesce(max(gone.e), 0) FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id GROUP BY d.doc_id, d.h
), kept AS (
  SELECT d.doc_id, string_agg(substr(d.h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) AS h, sum(upto - since) AS n FROM edges JOIN d ON d.doc_id = edges.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, (length(d.h) // 2 - kept.n)::BIGINT AS n_removed,
       (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id
"""
