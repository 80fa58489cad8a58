"""Operator 10: removal of long repeated byte strings by suffix arrays.

Windows of 400 bytes that share a minimiser meet in one task, which drops the minimisers that occur once and cuts the
rest into shards of a few megabytes. Each shard gets a suffix array by Larsson-Sadakane refinement: suffixes are sorted
by their first 7 symbols, and groups not yet settled are re-sorted by the rank of the suffix 7, 14, 28, ... symbols on.
Kasai's rule gives the common prefixes of neighbours: where the neighbour of the next suffix is the next suffix of the
neighbour, the prefix is one shorter; only the others are compared. A common prefix of 400 bytes means a repeat. Where
one minimiser's bytes exceed a shard, its windows are dealt out anew by their next minimiser, in a new order in which what is
frequent there comes last, so the work grows with the bytes. Only windows that this keeps together (they hold the same few
runs of bytes) take shards that are merged: those still single in one are looked up in the suffix arrays of the others by
binary search. TILE suffix arrays are held at a time, and those of the shards before them are built anew to meet them, so
memory does not grow with the minimiser.

Every byte covered by a 400-byte string that also starts anywhere else is removed, in all its places. Null text is
empty. Equal rows repeat each other, whatever their ids; a null or repeated id joins no rows. Matches never cross
documents, and are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .superwindows import Received, Shape, found_spans, keyed, union, unpacked, with_spans
from .text import U, spread

#: Bytes of a shard, and shards held at once.
SHARD, TILE = 1 << 19, 16
SYMBOLS = 7


class Shard:
    """The stretches i:j: their bytes and window starts; with a window or once `built`, suffix order and common prefixes."""

    def __init__(self, r: Received, i: int, j: int, window: int = 0):
        size, self.windows, self.index = r.size[i:j], r.windows[i:j], np.arange(i, j)
        self.buf = np.frombuffer(b"".join(r.texts(i, j)), np.uint8)
        self.from_ = np.cumsum(size) - size
        self.size = size
        if window:
            self.built(window)

    def built(self, window: int) -> Shard:
        n = len(self.buf)
        self.end = np.repeat(self.from_ + self.size, self.size)
        self.key = np.zeros(n, U)
        place = np.arange(n)
        for s in range(SYMBOLS):
            symbol = np.zeros(n, U)
            symbol[: n - s] = self.buf[s:].astype(U) + U(1)
            symbol[place + s >= self.end] = 0
            self.key = self.key << U(9) | symbol
        del place, symbol
        self.sort(window)
        return self

    def sort(self, window: int) -> None:
        """Larsson-Sadakane: sa, and rank (equal for suffixes equal up to the window's length)."""
        n = len(self.buf)
        self.sa = np.argsort(self.key)
        k = self.key[self.sa]
        edge = np.append(True, k[1:] != k[:-1])
        rank = np.empty(n + 1, np.int64)
        rank[n] = 0
        rank[self.sa] = np.maximum.accumulate(np.where(edge, np.arange(n), 0)) + 1
        slots = np.flatnonzero(~edge | ~np.append(edge[1:], True))
        h, self.levels = SYMBOLS, [(SYMBOLS, rank.astype(np.int32))]
        while h < window and len(slots):
            at = self.sa[slots]
            step = min(h, window - h)
            beyond = at + step
            next_ = np.where(beyond < self.end[at], rank[np.minimum(beyond, n)], 0)
            key = rank[at].astype(U) << U(32) | next_.astype(U)
            order = np.argsort(key)
            key, at = key[order], at[order]
            self.sa[slots] = at
            edge = np.append(True, key[1:] != key[:-1])
            rank[at] = np.maximum.accumulate(np.where(edge, slots, 0)) + 1
            slots = slots[~edge | ~np.append(edge[1:], True)]
            h += step
            self.levels.append((h, rank.astype(np.int32)))
        self.rank = rank

    def common_prefixes(self) -> np.ndarray:
        """Of each suffix with its predecessor in the array, by place in the text."""
        n = len(self.buf)
        before = np.full(n, -1)
        before[self.sa[1:]] = self.sa[:-1]
        b = before[:-1]
        b1 = np.maximum(b, 0)
        follows = np.zeros(n, bool)
        follows[1:] = (b >= 0) & (before[1:] == b + 1) & (self.buf[:-1] == self.buf[b1]) & (self.end[1:] == self.end[:-1])
        follows[1:] &= self.end[np.minimum(b1 + 1, n - 1)] == self.end[b1]
        a = np.flatnonzero(~follows & (before >= 0))
        b, length = before[a], np.zeros(len(a), np.int64)
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        # ranks of each refinement tell whether so many symbols agree; the longest step is taken as often as it fits
        for size, rank in reversed(self.levels):
            live = np.arange(len(a)) if size == self.levels[-1][0] else np.flatnonzero(length + size <= most)
            while len(live):
                live = live[length[live] + size <= most[live]]
                live = live[rank[a[live] + length[live]] == rank[b[live] + length[live]]]
                length[live] += size
                if size != self.levels[-1][0]:
                    break
        part = np.flatnonzero(length < most)
        diff, same = self.key[a[part] + length[part]] ^ self.key[b[part] + length[part]], np.zeros(len(part), np.int64)
        for i in range(1, SYMBOLS):
            same += diff < U(1) << U(9 * i)
        length[part] = np.minimum(length[part] + same, most[part])
        out = np.zeros(n, np.int64)
        out[a] = length
        anchor = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
        return np.where(follows, out[anchor] - (np.arange(n) - anchor), out)

    def repeated(self, window: int) -> np.ndarray:
        """By place: does the string of `window` bytes also start elsewhere in the shard?"""
        shared = self.common_prefixes() >= window
        out = shared.copy()
        at = np.flatnonzero(shared[self.sa])
        out[self.sa[at - 1]] = True
        return out

    def slim(self) -> Shard:
        """Without what only `repeated` reads."""
        del self.key, self.levels
        self.sa, self.rank, self.end = (x.astype(np.int32) for x in (self.sa, self.rank, self.end))
        return self

    def starts(self) -> np.ndarray:
        return spread(self.from_, self.windows)

    def holds(self, other: Shard, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(found?, place here) of the windows at `places` of another shard, by binary search in the suffix array."""
        mine = self.sa[np.isin(self.sa, self.starts(), kind="table")]
        found, where = np.zeros(len(places), bool), np.zeros(len(places), np.int64)
        ahead = np.arange(window)
        for c in range(0, len(places), 4096):
            p = places[c : c + 4096]
            want = other.buf[p[:, None] + ahead]
            lo, hi = np.zeros(len(p), np.int64), np.full(len(p), len(mine))
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, len(mine) - 1)
                have = self.buf[mine[mid][:, None] + ahead]
                unlike = have != want
                first = unlike.argmax(1)
                row = np.arange(len(p))
                less = unlike[row, first] & (have[row, first] < want[row, first])
                open_ = lo < hi
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            at = np.minimum(lo, len(mine) - 1)
            found[c : c + 4096] = (lo < len(mine)) & (self.buf[mine[at][:, None] + ahead] == want).all(1)
            where[c : c + 4096] = mine[at]
        return found, where


def runs(r: Received, shard: Shard, repeated: np.ndarray, window: int):
    """(doc, mark, lo, hi) of the runs of repeated windows."""
    owner = np.repeat(np.arange(len(shard.index)), shard.windows)
    at = shard.starts()
    lost = np.flatnonzero(repeated[at])
    if not len(lost):
        return None
    o = owner[lost]
    a = np.flatnonzero(np.append(True, (lost[1:] != lost[:-1] + 1) | (o[1:] != o[:-1])))
    b = np.append(a[1:], len(lost)) - 1
    own = shard.index[o[a]]
    lo = r.start[own] + at[lost[a]] - shard.from_[o[a]]
    return r.doc[own], r.mark[own], lo, lo + (lost[b] - lost[a]) + window


def judged(r: Received, window: int):
    """Equal stretches are one with a weight: its places are repeats of each other, and the suffix arrays hold it once."""
    spans = r.merged(window)
    yield spans
    yield from in_shards(r, window)


def in_shards(r: Received, window: int, level: int = 0, most: int = 0):
    """The windows of a minimiser beyond a shard are dealt out anew, by their next minimiser, as often as that leaves at most
    half of them (`most`) together."""
    for i, j, large in r.slices(SHARD):
        if not large:
            shard = Shard(r, i, j, window)
            out = runs(r, shard, shard.repeated(window), window)
            del shard  # before the next one is built
            if out:
                yield out
            continue
        windows = int(r.windows[i:j].sum())
        if level and windows > most:
            yield from looked_up(r, i, j, window)
            continue
        divided = r.divided(i, j, SHARD, level)
        yield divided.merged(window)
        yield from in_shards(divided, window, level + 1, windows // 2)


def looked_up(r: Received, i: int, j: int, window: int):
    """The shards of one minimiser, merged pair by pair."""
    total = np.append(0, np.cumsum(r.size[i:j]))
    cut = [i, *(i + np.searchsorted(total, np.arange(SHARD, total[-1], SHARD))).tolist(), j]
    bare = [Shard(r, a, b) for a, b in zip(cut, cut[1:], strict=False) if a < b]
    marks: list[np.ndarray] = []
    for x in range(0, len(bare), TILE):
        tile = []
        for s in bare[x : x + TILE]:
            marks.append(s.built(window).repeated(window))
            tile.append(s.slim())
        for one in range(len(tile)):
            for two in range(one):
                met(tile[one], marks[x + one], tile[two], marks[x + two], window)
        for y in range(x):
            if all(mine[s.starts()].all() for s, mine in zip([*tile, bare[y]], [*marks[x:], marks[y]], strict=True)):
                continue
            before = Shard(r, int(bare[y].index[0]), int(bare[y].index[-1]) + 1, window).slim()
            for one, s in enumerate(tile):
                met(s, marks[x + one], before, marks[y], window)
        for s in tile:
            del s.sa, s.rank, s.end
    for s, own in zip(bare, marks, strict=True):
        out = runs(r, s, own, window)
        if out:
            yield out


def met(a: Shard, of_a: np.ndarray, b: Shard, of_b: np.ndarray, window: int) -> None:
    """Marks in both shards what one window of the other equals: one of each group of equal ones is looked up, and a hit
    marks all of both groups."""
    for one, mine, two, its in ((a, of_a, b, of_b), (b, of_b, a, of_a)):
        at = one.starts()
        at = at[~mine[at]]
        if not len(at):
            continue
        hit, where = two.holds(one, at, window)
        mine[at[hit]] = True
        its |= np.isin(two.rank[:-1], two.rank[where[hit]]) & (two.end - np.arange(len(two.buf)) >= window)


def every(doc, mark, start, units, some, first):
    """A chunk's equal stretches are removed in all their places; one of them travels."""
    return (doc[some], mark[some], start[some], start[some] + units[some]), some[some != first]


def remove_repeated_bytes(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep: list[str] = ()) -> DataFrame:
    """Per row: id_col, the columns of `keep`, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; `with_text`
    adds `kept`, the rest as text (without code points that lost a byte), and the removed ranges as `spans`."""
    own = keyed(docs, id_col, text_col, keep)
    shape = Shape(False, window, max(1, min(32, window // 8)))
    spans = found_spans(own, shape, every, lambda r: judged(r, window))
    pair = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    longs = [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([own.schema["id"], *longs, T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.StringType()), T.StructField("spans", pair)] if with_text else [])])
    return with_spans(own, spans).mapInArrow(lambda batches: cut_out(batches, with_text, schema.names), schema).select("id.*", *schema.names[1:])


def cut_out(batches, with_text: bool, names: list[str]):
    """(id, packed text, spans) to the named columns."""
    for b in batches:
        sizes, gone, number, sums, kept, where = [], [], [], [], [], []
        for text, found in zip(unpacked(b), b.column(2).to_pylist(), strict=True):
            ranges = union(found, len(text))
            at, left = 0, []
            for lo, hi in ranges:
                left.append(text[at:lo])
                at = hi
            left.append(text[at:])
            out = b"".join(left)
            sizes.append(len(text))
            gone.append(len(text) - len(out))
            number.append(len(ranges))
            sums.append(hashlib.sha256(out).hexdigest())
            if with_text:
                kept.append("".join(x.decode(errors="ignore") for x in left))
                where.append([{"lo": x, "hi": y} for x, y in ranges])
        cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, number)), pa.array(sums, pa.string())]
        if with_text:
            cols += [pa.array(kept, pa.string()), pa.array(where, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
        yield pa.RecordBatch.from_arrays(cols, names=names)
