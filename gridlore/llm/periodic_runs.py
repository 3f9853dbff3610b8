"""Stretches of a text that repeat themselves: maximal runs of words with a period, and texts without their repeats.

Every octave of periods [2^k, 2^(k+1)) has its own tiles, one around every boundary, a multiple of the tile's step, wide
enough for the octave's periods. In a tile, Z-functions forwards and backwards from the boundary tell for each period
how far words equal the words a period on. A long run crosses many tiles and leaves a fragment in each; fragments are
shuffled by document and period and joined end to end. A run as long as is asked for always crosses the boundary of a tile
that holds eight words of it twice, so tiles whose eight words at the boundary don't come again in their octave are not made.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.llm.common import read, staged

LEAST_WORDS, LEAST_TURNS = 24, 3  # a run's words, and its periods
GRAM = 8  # words at a boundary that must come again; a run leaves as many behind some boundary
SHORT = 5  # octaves up to this one are solved many tiles at a time
CHARS_AT_ONCE = 2_000_000  # of texts that a task cuts at a time; one longer text alone

_NONE = np.empty(0, np.int64)


def words_in(text: str | None) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+; bytes split at ASCII white space just so."""
    return (text or "").encode().split()


def step_of(octave: int) -> int:
    return max(GRAM, 1 << octave)


def octaves_of(words: int) -> range:
    """Octaves whose least period has a run in so many words."""
    return range(0) if words < LEAST_WORDS else range(max(0, (words // LEAST_TURNS).bit_length()))


def boundaries(ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, text, boundary in the text) of the tiles to make. ids: the words of all texts, one text after the other."""
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids))
    fits = place + GRAM <= (first + sizes)[text]
    gram = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    padded = np.concatenate([ids, np.zeros(GRAM, ids.dtype)]).astype(np.uint64)
    for j in range(GRAM):  # a hash: what it wrongly takes for equal, the Z-functions find out
        gram = (gram ^ (padded[j : j + len(ids)] + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(32)
    at = place[fits]
    order = np.argsort(gram[at], kind="stable")
    at = at[order]
    new = np.concatenate([[True], np.diff(gram[at]) != 0]) if len(at) else np.empty(0, bool)
    rank = np.cumsum(new)
    again = np.zeros(len(at) + 1, bool)
    again[:-1] = ~new
    again[: len(at)] |= again[1:]
    keys = rank * len(ids) + at  # sorted: by gram, then place
    group = np.full(len(ids), -1, np.int64)
    group[at[again[:-1]]] = rank[again[:-1]]  # grams that come once can't begin a tile
    for k in range(int(sizes.max(initial=0)).bit_length()):
        step = step_of(k)
        b = np.flatnonzero((group >= 0) & ((place - first[text]) % step == 0) & (sizes[text] >= max(LEAST_WORDS, LEAST_TURNS << k)))
        if not len(b):
            continue
        next_one = keys[np.minimum(np.searchsorted(keys, group[b] * len(ids) + b + (1 << k)), len(keys) - 1)]
        least, most = group[b] * len(ids) + b + (1 << k), group[b] * len(ids) + np.minimum(b + (2 << k), len(ids))
        b = b[(next_one >= least) & (next_one < most)]
        if len(b):
            yield k, text[b], b - first[text[b]]


def z_function(s: np.ndarray, least: int = 1) -> np.ndarray:
    """How many values from each place on equal those from the start on; under `least` it is 0. Boxes are copied whole, so repeats
    cost little, and other places only the test of their first `least` values."""
    n = len(s)
    z = np.zeros(n, np.int64)
    if n < least or not n:
        return z
    z[0] = n
    same = s[1 : n - least + 1] == s[0]
    for j in range(1, least):
        same &= s[1 + j : n - least + 1 + j] == s[j]
    starts = np.flatnonzero(same) + 1
    k = known = 0
    while k < len(starts):
        i = int(starts[k])
        z[i] = m = _common(s, max(known, least), i)
        end, lo, known = i + m, i + 1, 0
        inside = n if end == n else end - least + 1  # behind it a copy can't tell whether `least` values are equal
        while lo < inside:  # inside [i, end) the text is its own start again: z is copied until a copy reaches the end
            hi = min(inside, lo + i)
            copy, room = z[lo - i : hi - i], end - np.arange(lo, hi)
            over = np.flatnonzero(copy >= room) if end < n else _NONE
            if len(over):
                z[lo : lo + over[0]] = copy[: over[0]]
                lo += int(over[0])
                known = end - lo
                break
            copy = np.minimum(copy, room)
            z[lo:hi] = np.where(copy >= least, copy, 0)
            lo = hi
        k = int(np.searchsorted(starts, lo))
    return z


def _common(s: np.ndarray, known: int, b: int) -> int:
    """Length of the common beginning of s and s[b:], of which so much is known; looked at in growing pieces."""
    at, piece = known, 16
    while b + at < len(s):
        x, y = s[at : at + piece], s[b + at : b + at + piece]
        differ = np.flatnonzero(x[: len(y)] != y)
        if len(differ):
            return at + int(differ[0])
        at += len(y)
        piece *= 4
    return at


def tile_of(ids: np.ndarray, octave: int, boundary: int) -> tuple[int, np.ndarray]:
    """(words before the boundary, words): a step before it, and behind it the octave's longest period and two steps."""
    step = step_of(octave)
    lo = max(0, boundary - step)
    return boundary - lo, ids[lo : boundary + 2 * step + (2 << octave)]


def fragments(octave: int, before: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, start, end), relative to the boundary: where words equal the words a period on, as far as the tile looks.

    Fragments that end inside the tile on both sides and are too short are left out.
    """
    step, least, most = step_of(octave), 1 << octave, 2 << octave
    ahead = z_function(words[before:], GRAM)[least:most]
    period = least + np.flatnonzero(ahead)
    ahead = np.minimum(ahead[period - least], 2 * step)
    # backwards: how far the words before a place a period on equal the words before the boundary
    if len(period) * before <= 8 * len(words):  # few periods: looked at one by one
        back = np.array([_common_back(words, before, q) for q in period.tolist()], np.int64)
    else:
        both = np.concatenate([words[:before][::-1], [-1], words[: before + most][::-1]])
        back = np.minimum(z_function(both)[len(both) - before - period], before)
    keep = kept(octave, before, period, back, ahead)
    return period[keep], -back[keep], ahead[keep]


def _common_back(words: np.ndarray, before: int, period: int) -> int:
    differ = np.flatnonzero(words[:before] != words[period : before + period])
    return before - 1 - int(differ[-1]) if len(differ) else before


def kept(octave: int, before: np.ndarray | int, period: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Fragments that may go on beyond the tile, or are long enough."""
    step = step_of(octave)
    goes_on = ((back == before) & (before == step)) | (ahead == 2 * step)
    return goes_on | (back + ahead + period >= np.maximum(LEAST_WORDS, LEAST_TURNS * period))


def short_fragments(octave: int, before: np.ndarray, tiles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tile, period, start, end) of many tiles of one short octave: their Z-values at its periods, period by period over all tiles."""
    step, most = step_of(octave), 2 << octave
    rows = np.full((len(tiles), 3 * step + most), -2, np.int32)  # the boundary is at column `step`
    rows[:, :step] = -1
    for k, (b, w) in enumerate(zip(before.tolist(), tiles)):
        rows[k, step - b : step - b + len(w)] = w
    out = []
    for q in range(1 << octave, most):
        far = rows[:, step : step + GRAM] == rows[:, step + q : step + q + GRAM]
        at = np.flatnonzero(far.all(1))
        if not len(at):
            continue
        some = rows[at]
        ahead = _first_false(some[:, step : 3 * step] == some[:, step + q : 3 * step + q])
        back = np.minimum(_first_false((some[:, :step] == some[:, q : step + q])[:, ::-1]), before[at])
        keep = kept(octave, before[at], np.full(len(at), q), back, ahead)
        out.append((at[keep], np.full(int(keep.sum()), q), -back[keep], ahead[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (_NONE,) * 4


def _first_false(equal: np.ndarray) -> np.ndarray:
    return np.where(equal.all(1), equal.shape[1], equal.argmin(1))


def joined(key: np.ndarray, period: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of numbered keys that touch or overlap, joined: a map side's step."""
    order = np.lexsort((start, period, key))
    key, period, start, end = key[order], period[order], start[order], end[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (period[1:] != period[:-1])
    group = np.cumsum(new)
    wide = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(group * wide + end) - group * wide  # the greatest end of the group so far
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return key[first], period[first], start[first], np.maximum.reduceat(end, first) if len(first) else end


CUT = "key string, octave int, boundary long, before int, words binary, doc_id long, text string, n_words long, plain string"


def cut(docs: DataFrame) -> DataFrame:
    """Rows of two kinds from (key, doc_id, text): one a document, with n_words and the digest of its words joined by a space
    (`plain`), its text only if it has tiles; and one a tile, with its words as numbers that hold within one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _pieces(batches):
            words = [words_in(t) for _, _, t in held]
            found = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode().indices
            ids, sizes = found.to_numpy(zero_copy_only=False).astype(np.int32), np.array([len(w) for w in words], np.int64)
            first, tiled, tiles = np.cumsum(sizes) - sizes, set(), []
            for k, text, boundary in boundaries(ids, sizes):
                for t, b in zip(text.tolist(), boundary.tolist()):
                    tiled.add(t)
                    tiles.append((held[t][0], k, b, *tile_of(ids[first[t] : first[t] + sizes[t]], k, b)))
                    if len(tiles) == 2000:
                        yield _tiles(tiles)
                        tiles = []
            if tiles:
                yield _tiles(tiles)
            done = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            columns = {"key": [h[0] for h in held], "doc_id": [h[1] for h in held], "text": [h[2] if k in tiled else None for k, h in enumerate(held)], "n_words": sizes, "plain": done}
            yield _batch(columns, len(held))

    return docs.select("key", "doc_id", "text").mapInArrow(run, CUT)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[str, int | None, str | None]]]:
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
            held.append(row)
            size += len(row[2] or "")
            if size > CHARS_AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


_ARROW = {"key": pa.string(), "octave": pa.int32(), "boundary": pa.int64(), "before": pa.int32(), "words": pa.binary(), "doc_id": pa.int64(), "text": pa.string(), "n_words": pa.int64(), "plain": pa.string()}


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in _ARROW.items()], names=list(_ARROW))


def _tiles(tiles: list[tuple]) -> pa.RecordBatch:
    key, octave, boundary, before, words = zip(*tiles)
    return _batch({"key": key, "octave": octave, "boundary": boundary, "before": before, "words": [w.tobytes() for w in words]}, len(tiles))


def solve(tiles: DataFrame) -> DataFrame:
    """Fragments (key, period, start, end) of tiles; tiles know nothing of each other. What a task has of one run is joined there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [np.frombuffer(w, np.int32) for w in batch["words"]]
            octave, boundary, before = (batch[c].to_numpy(np.int64) for c in ("octave", "boundary", "before"))
            number, names = pd.factorize(batch["key"])
            out = []
            for k in np.unique(octave).tolist():
                at = np.flatnonzero(octave == k)
                if k <= SHORT:
                    tile, period, start, end = short_fragments(k, before[at], [words[i] for i in at.tolist()])
                    out.append((at[tile], period, start, end))
                    continue
                for i in at.tolist():
                    period, start, end = fragments(k, int(before[i]), words[i])
                    out.append((np.full(len(period), i), period, start, end))
            tile, period, start, end = (np.concatenate(c) for c in zip(*out)) if out else (_NONE,) * 4
            key, period, start, end = joined(number[tile], period, start + boundary[tile], end + boundary[tile])
            yield pd.DataFrame({"key": names[key], "period": period, "start": start, "end": end})

    return tiles.select("key", "octave", "boundary", "before", "words").mapInPandas(run, "key string, period long, start long, end long")


def runs_of(parts: DataFrame) -> DataFrame:
    """(key, start, length, period) of all maximal runs from fragments: joined by document and period, long enough, and of the
    smallest period of their stretch."""
    by = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = parts.withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("key", "period", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.withColumn("length", F.col("end") - F.col("start") + F.col("period")).where((F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_TURNS * F.col("period")))
    # a stretch with a period has it in multiples too, from and to the same words
    return whole.groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def key_of(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: the id and a digest of the text; rows equal in both have the same runs."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
NO_RUNS = hashlib.sha256(b"").hexdigest()


def summary(runs: list[tuple[int, int, int]], words: list[bytes]) -> tuple:
    """What RESULT says of a document from its runs (start, length, period)."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = None
    for r in runs:  # the first of the greatest length / period, compared exactly
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    left = b" ".join([w for w, d in zip(words, np.cumsum(drop).tolist()) if not d])
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    start, length, period = best or (None, None, None)
    return len(runs), start, length, period, 1000 * length // period if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), runs, left.decode()


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, all runs, the strongest one, and the text without repeats, for rows (doc_id, text).

    A row gives a row: repeated rows give equal ones. Null and empty texts have no words and no runs; a null doc_id is kept
    as it is; ties go to the smallest start, then period; other columns are dropped; an empty table gives no rows. `collapsed`
    is null where nothing was dropped: it would be the words joined by one space.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", key_of(F.col("doc_id"), F.col("text")))
    parts = staged(cut(docs), "runs-tiles")
    found = runs_of(solve(parts.where("words IS NOT NULL")))
    lists = found.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))  # fewer than words

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = RESULT.replace(", runs array<struct<start:long,length:long,period:long>>", ", runs x").split(", ")
        for batch in batches:
            out = []
            for doc_id, text, n, runs in zip(batch["doc_id"], batch["text"], batch["n_words"], batch["runs"]):
                told = [] if runs is None else [(r["start"], r["length"], r["period"]) for r in runs]
                out.append((doc_id, n, *summary(told, words_in(text))))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in names])
            for c in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli"):
                frame[c] = frame[c].astype("Int64")
            frame["runs"] = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in frame["runs"]]
            yield frame

    whole = parts.where("words IS NULL")
    some = whole.where("text IS NOT NULL").join(lists, "key", "left").select("doc_id", "text", "n_words", "runs").mapInPandas(close, RESULT)
    none = whole.where("text IS NULL")
    empty = {"n_runs": F.lit(0).cast("long"), **{c: F.lit(None).cast("long") for c in ("start", "length", "period", "exponent_milli")}, "runs_sha256": F.lit(NO_RUNS), "collapsed_sha256": F.col("plain"), "runs": F.array().cast("array<struct<start:long,length:long,period:long>>"), "collapsed": F.lit(None).cast("string")}
    return some.unionByName(none.withColumns(empty).select(some.columns))


def planted(doc_id: Column, text: Column) -> Column:
    """The text with every tenth document's end, chosen by the checksum of its id, made periodic; other texts as they are.

    h = crc32(id), g = h div 10; where h mod 10 = 0, each word i >= a becomes word a + (i - a) mod p, with a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). Documents without words or without an id stay.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def change(pair: Column) -> Column:
        n, g = F.size(pair["w"]).cast("long"), pair["g"]
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        head, tail = F.slice(pair["w"], 1, a.cast("int")), F.slice(pair["w"], (a + 1).cast("int"), p.cast("int"))
        turns = F.flatten(F.array_repeat(tail, F.ceil((n - a) / p).cast("int")))
        return F.concat_ws(" ", F.concat(head, F.slice(turns, 1, (n - a).cast("int"))))

    one = F.get(F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), lambda x: F.when(F.size(x["w"]) > 0, change(x))), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(one, text)).otherwise(text)


def op11_period_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find_runs(docs.withColumn("text", planted(F.col("doc_id"), F.col("text")))).drop("runs", "collapsed")
