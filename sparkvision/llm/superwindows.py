"""Windows of fixed length that share a minimiser travel together: the shuffle under operators 4 and 10.

Each window of `window` units (words or bytes) has a minimiser: the smallest hash among its runs of `k` units. Equal
windows have equal minimisers, so they meet wherever windows are dealt out by it. Consecutive windows with the same
minimiser are one stretch of text, sent once, compressed, to the partition of that minimiser.

Runs of k units that make up more than 1/65536 of all such runs (frequent lines, passages of a large group of copies)
count as greater than all others, so a window takes one of them only if it holds nothing else; all such stretches of a
chunk are then equal, and equal stretches of a chunk (by their contents, not a hash) are sent once; in operator 4 those that
different texts of one id hold at one earliest place are all sent, and kept below, as one does not tell what becomes of the others.
The table of those runs has at most 65536 entries.
Stretches under such a minimiser (hot) take two steps: first they are dealt out by minimiser and chunk to about the root
of all partitions, where equal ones become one; what is left of each partition then goes to the minimiser's own. A task
that takes in more than CONDENSE compressed bytes makes equal stretches one as it reads, so it holds different ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import dropped, for_bytes, parts, reused, written
from .text import CHUNK, U, WORD_BASE, Chunk, chunks, mix, powers, spread, window_minimum

SHARE = 1 << 16
#: Bytes of stretches that a task takes in.
TASK_BYTES = 24 << 20
#: Compressed bytes of stretches after which a task looks for equal ones before it takes in more.
CONDENSE = 24 << 20
SPANS = "p int, blob binary, doc long, mark long, lo long, hi long, hot boolean"
#: Stands for a null document id; sorts before all others.
NO_ID = -(1 << 63)
#: Columns of a blob as they travel; ids as differences from row to row. 32 bits of the minimiser group the stretches of a
#: partition: a chance meeting of two minimisers costs a comparison and changes no result.
HEADER = (("minimum", np.uint32), ("doc", np.int64), ("mark", np.int64), ("start", np.uint32), ("windows", np.uint32), ("size", np.uint32), ("recurs", np.bool_))
_up: list[np.ndarray] = []


def word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _up or len(_up[0]) < n:
        m = max(n, 1 << 20)
        up, down = np.full(m, WORD_BASE), np.full(m, U(pow(int(WORD_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _up[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _up[0], _up[1]


@dataclass(frozen=True)
class Shape:
    words: bool
    window: int
    k: int

    def grams(self, c: Chunk) -> np.ndarray:
        """The hash of the k units at each place of the chunk; sets the prefix sums that `ranges` reads."""
        if self.words:
            c.words()
            up, down = word_powers(len(c.hash) + 1)
            c.sums = np.zeros(len(c.hash) + 1, U)
            np.cumsum(c.hash * up[: len(c.hash)], out=c.sums[1:])
            c.from_, c.units = c.first[:-1], c.counts
        else:
            c.sums, (_, down) = c.prefix(), powers(len(c.buf) + 1)
            c.from_, c.units = c.begin, c.end - c.begin
        c.down = down
        n = max(0, len(c.sums) - self.k)
        return mix((c.sums[self.k :] - c.sums[:n]) * down[:n])

    def ranges(self, c: Chunk, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of the units at:at+length, to find those whose contents are worth comparing."""
        return mix((c.sums[at + length] - c.sums[at]) * c.down[at] + length.astype(U) * U(0x9E3779B97F4A7C15))

    def content(self, c: Chunk, at: int, length: int) -> bytes:
        """What the units at:at+length hold: their bytes, or their words with a space between them."""
        return b" ".join(c.raw[c.start[at] : c.stop[at + length - 1]].split()) if self.words else c.raw[at : at + length]

    def inside(self, c: Chunk, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of each run of `length` units inside a text."""
        n = np.maximum(c.units - length + 1, 0)
        return spread(c.from_, n), np.repeat(np.arange(c.n), n)


def frequent(docs: DataFrame, shape: Shape) -> tuple[np.ndarray, int]:
    """(hashes of runs of k units above their share, bytes of all texts)."""

    def run(batches):
        for _, texts in chunks(batches, "text"):
            c = Chunk(texts)
            g = np.sort(shape.grams(c)[shape.inside(c, shape.k)[0]])
            edge = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
            n = np.diff(np.append(edge, len(g)))
            often = n >= max(4, len(g) // (2 * SHARE))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(g[edge[often]].view(np.int64), 0)), pa.array(np.append(n[often], len(g))), pa.array(np.append(np.zeros(often.sum(), np.int64), len(c.buf)))], names=["gram", "n", "size"])

    counted = docs.select("text").mapInArrow(run, "gram long, n long, size long").groupBy("gram", (F.col("size") > 0).alias("all")).agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    counted = reused(counted)
    total = counted.where("all").agg(F.sum("n"), F.sum("size")).first()
    rows = counted.where(~F.col("all") & (F.col("n") > max(16, (total[0] or 0) // SHARE))).select("gram").collect()
    dropped(counted)
    return np.array([r[0] for r in rows], np.int64).view(U), total[1] or 0


def stretches(c: Chunk, shape: Shape, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimiser, text, first unit in the chunk, number of windows, can it hold equal windows?) of each stretch."""
    g = shape.grams(c)
    flags = np.zeros(1 << 20, bool)
    flags[(hot & U(0xFFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(flags[(g & U(0xFFFFF)).astype(np.int64)])
    value = g >> U(1)
    if len(maybe):
        value[maybe[np.isin(g[maybe], hot)]] |= U(1 << 63)
    return cut_by(c, shape, value)


def cut_by(c: Chunk, shape: Shape, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches of windows with one minimiser, by a value for each run of k units."""
    least = window_minimum(value, shape.window - shape.k + 1)
    at, doc = shape.inside(c, shape.window)
    least = least[at]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (least[1:] != least[:-1]))) if len(at) else np.zeros(0, np.int64)
    windows = np.diff(np.append(new, len(at)))
    # equal windows of one stretch: the minimiser comes again, so it stands first in a window that is not the last
    again = value[at] == least
    again[new + windows - 1] = False
    recurs = np.logical_or.reduceat(again, new) if len(new) else np.zeros(0, bool)
    return least[new], doc[new], at[new], windows, recurs


def batch_of(p, hot, blobs, spans=None) -> pa.RecordBatch:
    """Rows of SPANS: blobs, or else spans."""
    n = len(p)
    own = [pa.nulls(n, pa.int64())] * 4 if spans is None else [pa.array(x, pa.int64()) for x in spans]
    body = pa.nulls(n, pa.binary()) if blobs is None else pa.array(blobs, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), body, *own, pa.array(hot, pa.bool_())], names=["p", "blob", "doc", "mark", "lo", "hi", "hot"])


def numbered(c: Chunk, shape: Shape, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each stretch, the same for those with equal contents: where hashes agree, contents are compared."""
    h = shape.ranges(c, at, length)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out, number = len(h) + np.arange(len(h)), {}
    for i in order[np.append(False, same) | np.append(same, False)].tolist():
        out[i] = number.setdefault(shape.content(c, at[i], length[i]), len(number))
    return out


def equal_ones(content: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the members of groups of equal content, sorted by group, document, place and mark; the first of the group of each)."""
    order = np.argsort(content)
    same = content[order][1:] == content[order][:-1]
    some = order[(np.append(False, same) | np.append(same, False))[: len(order)]]
    some = some[np.lexsort((mark[some], start[some], doc[some], content[some]))]
    head = np.append(True, content[some][1:] != content[some][:-1])[: len(some)]
    return some, some[np.flatnonzero(head)][np.cumsum(head) - 1] if len(some) else some


def packed_blob(cols: dict[str, np.ndarray], bodies: list[bytes]) -> bytes:
    """Stretches as they travel; ids as differences from row to row."""
    pack = zstandard.ZstdCompressor(level=3)
    own = cols | {"doc": np.diff(cols["doc"], prepend=0)}
    head = b"".join(own[name].astype(kind).tobytes() for name, kind in HEADER)
    head = pack.compress(len(bodies).to_bytes(8, "little") + head)
    return len(head).to_bytes(8, "little") + head + pack.compress(b"".join(bodies))


def send(batches, shape: Shape, hot: np.ndarray, partitions: int, local: Callable) -> Iterator[pa.RecordBatch]:
    """Blobs of different stretches by partition, and the spans that `local` finds among a chunk's equal stretches."""
    salts = int(np.ceil(np.sqrt(partitions)))
    for rows, texts in chunks(batches, "text"):
        c = Chunk(texts)
        least, text, unit, windows, recurs = stretches(c, shape, hot)
        if not len(least):
            continue
        doc, mark = (np.asarray(rows.column(i)) for i in (1, 2))
        doc, mark, start = doc[text], mark[text], unit - c.from_[text]
        units = windows + shape.window - 1
        travels = np.ones(len(least), bool)
        some, first = equal_ones(numbered(c, shape, unit, units), doc, mark, start)
        if len(some):
            span, settled = local(doc, mark, start, units, some, first)
            travels[settled] = False
            yield batch_of((mix(span[0].view(U) + span[2].astype(U)) % U(partitions)).astype(np.int32), np.zeros(len(span[0]), bool), None, span)
        go = np.flatnonzero(travels)
        warm = least[go] >> U(63) > 0
        salt = mix(least[go]) + (mix(doc[:1].view(U) ^ mark[:1].view(U)) % U(salts)) * warm
        part = (mix(salt) % U(partitions)).astype(np.int64)
        order = np.lexsort((warm, part))
        go, part, warm = go[order], part[order], warm[order]
        if shape.words:
            a, b = c.start[unit[go]], c.stop[unit[go] + units[go] - 1]
        else:
            a, b = unit[go], unit[go] + units[go]
        cols = {"minimum": mix(least) & U(0xFFFFFFFF), "doc": doc, "mark": mark, "start": start, "windows": windows, "recurs": recurs}
        edge = np.append(np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (warm[1:] != warm[:-1]))), len(part))
        blobs = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = {name: v[go[i:j]] for name, v in cols.items()} | {"size": b[i:j] - a[i:j]}
            blobs.append(packed_blob(own, [c.raw[x:y] for x, y in zip(a[i:j].tolist(), b[i:j].tolist(), strict=True)]))
        yield batch_of(part[edge[:-1]], warm[edge[:-1]], blobs)


class Received:
    """The stretches of one partition whose minimiser occurs more than once (or all of them), in its order."""

    def __init__(self, blobs: list[bytes], shape: Shape, every: bool = False):
        self.shape = shape
        cols: dict[str, list] = {name: [] for name, _ in HEADER}
        heads = [int.from_bytes(blob[:8], "little") + 8 for blob in blobs]
        for blob, end in zip(blobs, heads, strict=True):
            raw = zstandard.decompress(blob[8:end])
            n, at = int.from_bytes(raw[:8], "little"), 8
            for name, kind in HEADER:
                cols[name].append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            cols["doc"][-1] = np.cumsum(cols["doc"][-1])
        source = np.repeat(np.arange(len(blobs)), [len(x) for x in cols["size"]])
        joined = {name: np.concatenate(cols.pop(name)).astype(np.uint32 if name == "minimum" else np.int64) for name, _ in HEADER}
        order = np.argsort(joined["minimum"], kind="stable")
        m = joined["minimum"][order]
        number = np.bincount(np.cumsum(np.append(True, m[1:] != m[:-1])) - 1)
        often = np.zeros(len(order), bool)
        often[order] = np.repeat(number, number) > 1
        often |= (joined["recurs"] > 0) | every
        # only now the texts, and of each blob only those that are asked for
        bodies, offset, base = [], np.zeros(len(order), np.int64), 0
        for k, (blob, end) in enumerate(zip(blobs, heads, strict=True)):
            own = slice(*np.searchsorted(source, [k, k + 1]))
            size, go = joined["size"][own], often[own]
            stop = np.cumsum(size)
            raw = zstandard.decompress(blob[end:])
            kept = [raw[y - n : y] for y, n in zip(stop[go].tolist(), size[go].tolist(), strict=True)]
            offset[own] = np.where(go, base + np.cumsum(size * go) - size, 0)
            bodies.append(b"".join(kept))
            base += len(bodies[-1])
        order = order[often[order]]
        self.__dict__ |= {name: v[order] for name, v in joined.items()}
        self.offset, self.body = offset[order], b"".join(bodies)

    def texts(self, i: int, j: int) -> list[bytes]:
        return [self.body[a : a + n] for a, n in zip(self.offset[i:j].tolist(), self.size[i:j].tolist(), strict=True)]

    def merged(self, window: int) -> tuple[np.ndarray, ...]:
        """Keeps one of each set of equal stretches, and of these only those that can still meet another; the spans
        (doc, mark, lo, hi) of all that had an equal."""
        number: dict[tuple[int, bytes], int] = {}
        key = np.fromiter((number.setdefault((m, t), len(number)) for m, t in zip(self.minimum.tolist(), self.texts(0, len(self.minimum)), strict=True)), np.int64, len(self.minimum))
        times = np.bincount(key, minlength=len(number))
        del number
        some = np.flatnonzero(times[key] > 1)
        out = self.doc[some], self.mark[some], self.start[some], self.start[some] + self.windows[some] + window - 1
        _, first = np.unique(key, return_index=True)
        first = np.sort(first)
        m = self.minimum[first]
        edge = np.append(True, m[1:] != m[:-1])[: len(m)]
        alone = np.bincount(np.cumsum(edge) - 1)
        keep = first[(np.repeat(alone, alone) > 1) | (self.recurs[first] > 0)]
        for name in (*(x for x, _ in HEADER), "offset"):
            setattr(self, name, getattr(self, name)[keep])
        return out

    def condensed(self, local: Callable) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """(the spans that `local` finds among equal stretches, the rows of the stretches that it does not settle)."""
        number: dict[tuple[int, bytes], int] = {}
        key = np.fromiter((number.setdefault((m, t), len(number)) for m, t in zip(self.minimum.tolist(), self.texts(0, len(self.minimum)), strict=True)), np.int64, len(self.minimum))
        some, first = equal_ones(key, self.doc, self.mark, self.start)
        spans, settled = local(self.doc, self.mark, self.start, self.windows + self.shape.window - 1, some, first)
        stays = np.ones(len(key), bool)
        stays[settled] = False
        return spans, np.flatnonzero(stays)

    def blob(self, rows: np.ndarray) -> bytes:
        cols = {name: getattr(self, name)[rows] for name, _ in HEADER}
        return packed_blob(cols, [self.body[a : a + n] for a, n in zip(self.offset[rows].tolist(), cols["size"].tolist(), strict=True)])

    def slices(self, limit: int) -> Iterator[tuple[int, int, bool]]:
        """Ranges of whole minimisers of about `limit` bytes; a minimiser beyond it comes alone (True)."""
        n = len(self.minimum)
        edge = np.append(np.flatnonzero(np.append(True, self.minimum[1:] != self.minimum[:-1])), n) if n else np.zeros(1, np.int64)
        total = np.append(0, np.cumsum(self.size))[edge]
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
            yield int(edge[i]), int(edge[j]), total[j] - total[i] > limit
            i = j

    def divided(self, i: int, j: int, limit: int, level: int) -> Received:
        """The windows of the stretches i:j, all of one minimiser, as stretches of their next one, of bytes: that of an order of
        its own for each `level`, in which runs of k that stand here more than limit / (2 * window) times come last. So only what
        holds nothing else can make a minimiser beyond `limit` bytes again. Equal windows have equal next minimisers; a stretch
        that meets no other is left out."""
        shape, salt = self.shape, mix(np.array([level], U))
        total = np.append(0, np.cumsum(self.size[i:j]))
        cut = [i, *(i + np.searchsorted(total, np.arange(CHUNK, total[-1], CHUNK))).tolist(), j]
        blocks = [(a, b) for a, b in zip(cut, cut[1:], strict=False) if a < b]
        most = max(1, limit // (2 * shape.window))
        slots = np.zeros(1 << int(8 * total[-1] // most).bit_length(), np.int64)

        def runs(a: int, b: int) -> tuple[Chunk, np.ndarray, np.ndarray]:
            c = Chunk(self.texts(a, b))
            g = mix(shape.grams(c) ^ salt)
            return c, g, (g & U(len(slots) - 1)).astype(np.int64)

        # a slot counts all runs with its hash, an eighth of `most` on average
        for a, b in blocks:
            c, _, slot = runs(a, b)
            slots += np.bincount(slot[shape.inside(c, shape.k)[0]], minlength=len(slots))
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in blocks:
            c, g, slot = runs(a, b)
            least, text, at, windows, recurs = cut_by(c, shape, g >> U(1) | (slots[slot] > most).astype(U) << U(63))
            found.append((least, text + a, at - c.begin[text], windows, recurs))
        least, own, ahead, windows, recurs = map(np.concatenate, zip(*found, strict=True))
        del found, slots
        order = np.argsort(least, kind="stable")
        edge = np.append(True, least[order][1:] != least[order][:-1])[: len(order)]
        number = np.bincount(np.cumsum(edge) - 1)
        order = order[(np.repeat(number, number) > 1) | recurs[order]]
        own, ahead, windows = own[order], ahead[order], windows[order]
        out = Received.__new__(Received)
        out.__dict__ |= {"shape": shape, "body": self.body, "minimum": least[order], "doc": self.doc[own], "mark": self.mark[own], "recurs": recurs[order].astype(np.int64)}
        out.__dict__ |= {"start": self.start[own] + ahead, "windows": windows, "size": windows + shape.window - 1, "offset": self.offset[own] + ahead}
        return out


class Inbox:
    """Blobs as a task reads them; beyond `most` bytes equal stretches become one, so it grows with different ones only."""

    def __init__(self, shape: Shape, local: Callable, most: int):
        self.shape, self.local, self.most = shape, local, most
        self.blobs: list[bytes] = []
        self.size, self.limit = 0, most

    def add(self, blobs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Takes the blobs in; yields the spans of what became one."""
        for blob in blobs:
            self.blobs.append(blob)
            self.size += len(blob)
            if self.size > self.limit:
                r = Received(self.blobs, self.shape, every=True)
                spans, rows = r.condensed(self.local)
                self.blobs = [r.blob(rows)]
                self.size = len(self.blobs[0])
                self.limit = max(self.most, 2 * self.size)
                yield spans


def found_spans(docs: DataFrame, shape: Shape, local: Callable, judge: Callable) -> DataFrame:
    """(doc, mark, spans: array of (lo, hi)) of the documents with any; docs has text, doc and mark.

    `local(doc, mark, start, units, some, first)` gives the spans of equal stretches, and those of `some` that are settled by
    them or by another stretch and need not travel; `judge(received)` yields (doc, mark, lo, hi) arrays for a partition's stretches."""
    hot, size = frequent(docs, shape)
    spark, most = docs.sparkSession, CONDENSE
    partitions = for_bytes(spark, size * 4, TASK_BYTES)
    table = spark.sparkContext.broadcast(hot)  # SHARE entries at most
    sent = docs.select("text", "doc", "mark").mapInArrow(lambda batches: send(batches, shape, table.value, partitions, local), SPANS)

    def receive(batches):
        usual, hot_ones = Inbox(shape, local, most), Inbox(shape, local, most)
        none = lambda spans: batch_of(np.zeros(len(spans[0]), np.int32), np.zeros(len(spans[0]), bool), None, spans)
        for b in batches:
            full, hot_row = (np.asarray(x) for x in (b.column(1).is_valid(), b.column(6)))
            for box, rows in ((usual, full & ~hot_row), (hot_ones, full & hot_row)):
                for spans in box.add(b.column(1).filter(pa.array(rows)).to_pylist()):
                    yield none(spans)
            if not full.all():
                yield b.filter(pa.array(~full))
        if usual.blobs:
            for spans in judge(Received(usual.blobs, shape)):
                yield none(spans)
        if hot_ones.blobs:
            r = Received(hot_ones.blobs, shape, every=True)
            spans, rows = r.condensed(local)
            yield none(spans)
            edge = np.append(np.flatnonzero(np.append(True, r.minimum[rows][1:] != r.minimum[rows][:-1])), len(rows))
            blobs = [r.blob(rows[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield batch_of(r.minimum[rows][edge[:-1]].astype(np.uint32).view(np.int32), np.ones(len(blobs), bool), blobs)

    def finish(batches):
        for b in receive(b.set_column(6, "hot", pa.array(np.zeros(b.num_rows, bool))) for b in batches):
            yield b.select(["doc", "mark", "lo", "hi"])

    # one partition for each p: a hash of p would bring several of them to one task. Written, as it is read twice
    first = written(sent.repartitionById(partitions, F.col("p")).mapInArrow(receive, SPANS), "spans")
    span = "doc long, mark long, lo long, hi long"
    rest = first.where("hot").repartition(parts(spark), "p").mapInArrow(finish, span)
    spans = first.where("NOT hot").select("doc", "mark", "lo", "hi").unionByName(rest)
    # rows that share id and text have equal spans, and a document has fewer different ones than units
    return spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def union(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Sorted disjoint ranges within 0..n."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, min(hi, n)])
    return [(a, min(b, n)) for a, b in out]


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """id (a struct of the id and the columns of `keep`), text, and (doc, mark): the id as a long with null as the least,
    and a 64-bit hash of the text, so that rows with one id (or none) but different texts stay apart."""
    id_ = F.col(id_col)
    mark = F.xxhash64(text_col)
    rest = F.struct(id_.alias(id_col), *[F.col(c) for c in keep if c != id_col])
    return docs.select(rest.alias("id"), F.col(text_col).alias("text"), F.coalesce(id_.cast("long"), F.lit(NO_ID)).alias("doc"), mark.alias("mark"))


def with_spans(own: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, packed text, spans) of every document; texts are compressed for the way."""
    schema = T.StructType([own.schema["id"], T.StructField("packed", T.BinaryType()), T.StructField("doc", T.LongType()), T.StructField("mark", T.LongType())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for rows, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([pack.compress(t) for t in texts], pa.binary()), rows.column(2), rows.column(3)], names=schema.names)

    return own.mapInArrow(run, schema).join(spans, ["doc", "mark"], "left").select("id", "packed", "spans")


def unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    return map(zstandard.decompress, batch.column(1).to_pylist())
