"""Operator 1: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Chosen-path join. Texts with equal shingle sets are one set. Each set is a sketch of up to 64 tokens: the least hash in
each of 64 parts of the hash range. In each run a set takes the path of every token whose hash for the run falls below
1 / (similarity x tokens); sets on one path are a bucket. Buckets of up to LIMIT sets (below the first level DEEP_LIMIT)
are compared by brute force on the sketches; larger ones are split again by further sampled tokens, DEPTH times at most, and
what is then still large is compared in blocks. Runs are repeated until a pair at the threshold is missed with a probability under 1 - RECALL: a path
of depth d survives a run with f(d) = 1 - exp(-f(d-1)), f(0) = 1, so ceil(log(1-RECALL) / log(1-f(DEPTH))) runs are made.

Sets whose sketches may be similar (5 standard deviations of tolerance) form candidate groups, and within these every
pair is decided exactly on the full shingle sets of the whole texts, as arrays of hashes, by products of incidence
matrices in blocks whose size is bounded. A group's sets are dealt to blocks by size class, each 1/similarity times the
one before: sets more than one class apart cannot be similar, and their blocks do not meet. Pairs are counted where they
are found and never listed; links between groups of copies are kept as a spanning forest. So no task holds a whole hot
group, and copies are not expanded.

A text of one to four words has one shingle, all its words. Null, empty and blank texts have none and link to nothing.
Rows with a null id take part and get their group's class. Equal rows are copies. A set is represented by one row, known
by id and text, so null and repeated ids meet nothing but their own. Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components, labelled
from .scratch import dropped, reused, written
from .skew import hot_keys, spread_join
from .text import U, Chunk, chunks, components, mix, spread

BINS = 64
LIMIT = 256
DEPTH = 3
#: Sets of a bucket that are compared at once below the first level, where splitting on has cost more than it saves.
DEEP_LIMIT = 4096
RECALL = 0.9999
#: Sets and shingles of a block in the exact comparison.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 500_000
SEED = U(0xA0761D6478BD642F)


def runs_for(recall: float, depth: int) -> int:
    f = 1.0
    for _ in range(depth):
        f = 1 - math.exp(-f)
    return math.ceil(math.log(1 - recall) / math.log(1 - f))


def distinct_shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) sorted by text and hash, each once."""
    h, d = c.words().shingles(k)
    order = np.argsort(h)
    h, d = h[order], d[order]
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
    return h[new], d[new]


def signatures(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    """16 bytes that depend on the set alone."""
    some = np.flatnonzero(n)
    one, two = np.zeros(len(n), U), np.zeros(len(n), U)
    if len(some):
        one[some] = np.add.reduceat(mix(h ^ SEED), first[some])
        two[some] = np.add.reduceat(mix(h * SEED + U(7)), first[some])
    raw = np.stack([one + n.astype(U), two], 1).tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(n))]


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """(doc, sid, n, sketch, brief): the set's name, its size, the least hash (32 bits, 0 for none) of each of 64 parts, and
    a byte of each; behind them the columns of docs after text and doc."""
    more = docs.schema.fields[2:]
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("sid", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("brief", T.BinaryType()), *more])

    def run(batches):
        for rows, texts in chunks(batches, "text", 1 << 20):
            h, d = distinct_shingles(Chunk(texts), k)
            n = np.bincount(d, minlength=len(texts))
            first = np.cumsum(n) - n
            bin_ = d * BINS + (h >> U(58)).astype(np.int64)
            head = np.append(True, bin_[1:] != bin_[:-1])[: len(h)]
            sketch = np.zeros(len(texts) * BINS, np.uint32)
            sketch[bin_[head]] = np.maximum(h[head] >> U(20) & U(0xFFFFFFFF), U(1))
            raw, brief = sketch.tobytes(), np.where(sketch, np.maximum(sketch & 0xFF, 1), 0).astype(np.uint8).tobytes()
            some = np.flatnonzero(n)
            sid = signatures(h, first, n)
            size = 4 * BINS
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([rows.column(1).take(at), pa.array([sid[i] for i in some], pa.binary()), pa.array(n[some], pa.int64()), pa.array([raw[size * i : size * i + size] for i in some], pa.binary()), pa.array([brief[BINS * i : BINS * i + BINS] for i in some], pa.binary()), *[rows.column(2 + i).take(at) for i in range(len(more))]], names=schema.names)

    return docs.mapInArrow(run, schema)


def tokens(column: pa.Array, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, BINS)


def paths(batches, runs: int, similarity: float):
    """First-level paths of each set."""
    for b in batches:
        if not b.num_rows:
            continue
        s = tokens(b.column(1))
        share = 1 / (similarity * np.maximum(1, (s > 0).sum(1)))
        row, bin_ = np.nonzero(s)
        token = mix(s[row, bin_].astype(U) << U(8) | bin_.astype(U))
        for run in range(runs):
            path = mix(token ^ U((run + 1) * int(SEED) & (1 << 64) - 1))
            go = (path >> U(11)).astype(np.float64) * 2.0**-53 < share[row]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[go])), pa.array(path[go].view(np.int64))], names=["sid", "path"])


def deeper(batches, similarity: float):
    """(sid, path, sketch) to the same with the paths one token longer."""
    for b in batches:
        if not b.num_rows:
            continue
        s = tokens(b.column(2))
        share = 1 / (similarity * np.maximum(1, (s > 0).sum(1)))
        row, bin_ = np.nonzero(s)
        path = np.asarray(b.column(1)).view(U)
        next_ = mix(mix(s[row, bin_].astype(U) << U(8) | bin_.astype(U)) ^ mix(path[row] + SEED))
        go = (next_ >> U(11)).astype(np.float64) * 2.0**-53 < share[row]
        at = pa.array(row[go])
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(next_[go].view(np.int64)), b.column(2).take(at)], names=["sid", "path", "sketch"])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """May sets with these sketches reach the similarity? Bytes that agree by chance only let more through."""
    either = ((a > 0) | (b > 0)).sum(1)
    equal = ((a == b) & (a > 0)).sum(1)
    return equal >= either * similarity - 5 * np.sqrt(either * similarity * (1 - similarity))


def grouped(batches, columns: int):
    """Batches of whole groups of rows with equal first `columns`, which are sorted."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        keys = [np.asarray(t.column(i)) for i in range(columns)]
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for x in keys:
            new[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(new)[-1])
        rest = t.slice(last)
        if last:
            yield t.slice(0, last).combine_chunks(), np.flatnonzero(new)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def compared(batches, similarity: float):
    """(path, one, two, side, sid, brief) sorted by the first three: a forest of the pairs of each bucket that may be similar."""
    for t, first in grouped(batches, 3):
        n = np.diff(np.append(first, t.num_rows)) if first[-1] != t.num_rows else np.diff(first)
        first = first[: len(n)]
        s = tokens(t.column(5), np.uint8)
        sids = t.column(4).to_pylist()
        number: dict[bytes, int] = {}
        node = np.fromiter((number.setdefault(x, len(number)) for x in sids), np.int64, len(sids))
        names = list(number)
        side, cross = np.asarray(t.column(3)), (np.asarray(t.column(1)) != np.asarray(t.column(2)))
        left, right = [], []
        # each row with those after it in its group, some hundred thousand pairs at a time
        after = np.repeat(first + n, n) - np.arange(t.num_rows) - 1
        total = np.append(0, np.cumsum(after))
        i = 0
        while i < t.num_rows:
            j = max(i + 1, int(np.searchsorted(total, total[i] + 100_000, side="right")) - 1)
            a = np.repeat(np.arange(i, j), after[i:j])
            b = spread(np.arange(i, j) + 1, after[i:j])
            keep = (node[a] != node[b]) & (~cross[a] | (side[a] != side[b]))
            a, b = a[keep], b[keep]
            ok = alike(s[a], s[b], similarity)
            left.append(node[a[ok]])
            right.append(node[b[ok]])
            i = j
        label = components(len(names), np.concatenate(left), np.concatenate(right))
        some = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in some], pa.binary()), pa.array([names[x] for x in label[some]], pa.binary())], names=["u", "v"])


def blocks(rows: DataFrame, group: str, number: str, key: str) -> DataFrame:
    """Each row of a group with `number` blocks once for each pair of blocks that has its own: columns one, two, side."""
    own = rows.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(5)), F.col(number)).cast("int"))
    each = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(number).cast("int") - 1)))
    return each.select("*", F.least("_b", "_o").alias("one"), F.greatest("_b", "_o").alias("two"), F.col("_b").alias("side")).drop("_b", "_o")


def class_blocks(rows: DataFrame, key: str) -> DataFrame:
    """The same for rows with a size class `_c` and the blocks of each class of their group, `_blocks`: blocks are numbered by
    class, and only those of one class or of neighbours meet."""
    near = F.filter("_blocks", lambda b: F.abs(b["c"] - F.col("_c")) <= 1)
    own = rows.withColumn("_near", near).withColumn("_mine", F.filter("_near", lambda b: b["c"] == F.col("_c"))[0]["n"])
    own = own.withColumn("side", F.col("_c") * F.lit(1 << 32) + F.pmod(F.xxhash64(key, F.lit(5)), F.col("_mine")))
    others = F.flatten(F.transform("_near", lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["n"] - 1), lambda i: b["c"] * F.lit(1 << 32) + i)))
    each = own.withColumn("_o", F.explode(others))
    return each.select("*", F.least("side", "_o").alias("one"), F.greatest("side", "_o").alias("two")).drop("_near", "_mine", "_o", "_c", "_blocks")


def candidates(sets: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Links (u, v) that connect all sets which may be similar, and the tables of paths that they are computed from, which
    are to be given up once the links are written."""
    level = sets.select("sid", "sketch").mapInArrow(lambda b: paths(b, runs_for(RECALL, DEPTH), similarity), "sid binary, path long")
    small, held = None, []
    for depth in range(1, DEPTH + 1):
        sizes = reused(level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        rows = reused(spread_join(level, sizes, "path", "sid", hot_keys(sizes, "path", "n")))
        held += [sizes, rows]
        limit = LIMIT if depth == 1 else DEEP_LIMIT
        now = (rows if depth == DEPTH else rows.where(F.col("n") <= limit)).select("sid", "path", "n")
        small = now if small is None else small.unionByName(now)
        if depth == DEPTH:
            break
        hot = rows.where(F.col("n") > limit)
        hot = written((hot if depth > 1 else hot.join(sets.select("sid", "sketch"), "sid")).select("sid", "path", "sketch"), "hot")
        held.append(hot)
        if not hot.limit(1).count():
            break
        level = reused(hot.mapInArrow(lambda b: deeper(b, similarity), "sid binary, path long, sketch binary"))
        held.append(level)
    dealt = blocks(small.withColumn("_n", F.ceil(F.col("n") / F.lit(4 * LIMIT))), "path", "_n", "sid")
    full = dealt.join(sets.select("sid", "brief"), "sid").select("path", "one", "two", "side", "sid", "brief")
    links = full.repartition("path", "one", "two").sortWithinPartitions("path", "one", "two").mapInArrow(lambda b: compared(b, similarity), "u binary, v binary").distinct()
    return links, held


def intersections(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Shared shingles of each pair of n texts, from (hash, text) rows: products of incidence matrices over the shared."""
    values, at, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    column = np.cumsum(times > 1)[at[shared]] - 1
    row, m, out = d[shared], int((times > 1).sum()), np.zeros((n, n), np.float32)
    width = max(256, (1 << 22) // n)
    order = np.argsort(column)
    row, column = row[order], column[order]
    for c in range(0, m, width):
        i, j = np.searchsorted(column, [c, c + width])
        x = np.zeros((n, min(width, m - c)), np.float32)
        x[row[i:j], column[i:j] - c] = 1
        out += x @ x.T
    return out


def hashed(batches, k: int):
    """(group, _c, _blocks, sid, copies, text) with the sorted hashes of the set's shingles in place of the text."""
    for rows, texts in chunks(batches, "text", 1 << 20):
        h, d = distinct_shingles(Chunk(texts), k)
        n = np.bincount(d, minlength=len(texts))
        first = np.cumsum(n) - n
        # a row that is not the set which is meant, as two texts have one id and one hash, drops out
        meant = pa.array([i for i, (x, y) in enumerate(zip(signatures(h, first, n), rows.column(3).to_pylist(), strict=True)) if x == y], pa.int64())
        each = pa.array([h[a : a + m].tobytes() for a, m in zip(first.tolist(), n.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*rows.columns[:5], each], names=["group", "_c", "_blocks", "sid", "copies", "hashes"]).take(meant)


def decided(batches, similarity: float):
    """(group, one, two, side, sid, copies, hashes) sorted by the first three: per set its linked documents in the block, and a
    set of the same class."""
    for t, first in grouped(batches, 3):
        edge = first if first[-1] == t.num_rows else np.append(first, t.num_rows)
        sids, copies, side = t.column(4).to_pylist(), np.asarray(t.column(5)).astype(np.float64), np.asarray(t.column(3))
        cross = np.asarray(t.column(1)) != np.asarray(t.column(2))
        hashes = t.column(6).to_pylist()
        out_u, out_v, out_n = [], [], []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n = j - i
            if n < 2:
                continue
            own = [np.frombuffer(x, U) for x in hashes[i:j]]
            sizes = np.array([len(x) for x in own])
            both = intersections(np.concatenate(own), np.repeat(np.arange(n), sizes), n).astype(np.float64)
            linked = both * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-6
            np.fill_diagonal(linked, False)
            if cross[i]:
                linked &= side[i:j][:, None] != side[i:j][None, :]
            count = linked @ copies[i:j]
            label = components(n, *np.nonzero(linked))
            for x in np.flatnonzero(count):
                out_u.append(sids[i + x])
                out_v.append(sids[i + label[x]])
                out_n.append(int(count[x]))
        yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.binary()), pa.array(out_v, pa.binary()), pa.array(out_n, pa.int64())], names=["u", "v", "links"])


#: Columns that are never null and tell rows apart by id and text.
KEY = ["_id", "_none", "_mark"]


def keys(doc: str, none: str, mark: str) -> list[Column]:
    return [F.coalesce(doc, F.lit(0)).alias("_id"), F.col(none).alias("_none"), F.col(mark).alias("_mark")]


def joined(own: DataFrame, rows: DataFrame, k: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the sets of sketched rows, the links found among them, the label of each linked set). A set's `first` is (none, doc,
    mark) of the row with the least id, and of several the least hash of the text; null ids come last."""
    first = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")
    sets = written(rows.groupBy("sid").agg(F.min("doc").alias("rep"), F.min(first).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("brief").alias("brief")), "sets")
    links, held = candidates(sets, similarity)
    groups, tables = labelled(links)
    dropped(*held)
    sized = groups.join(sets.select("sid", "n", "copies", "first"), groups.node == sets.sid).withColumn("_c", F.floor(F.log(F.col("n")) / math.log(1 / similarity)).cast("int"))
    sized = reused(sized.select("label", "sid", "n", "copies", "first", "_c"))
    number = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_TEXTS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("long")
    per_class = sized.groupBy("label", "_c").agg(number.alias("_b"), F.count("*").alias("_rows"))
    # a group has fewer classes than a text could have powers of 1/similarity
    sizes = reused(per_class.groupBy("label").agg(F.collect_list(F.struct(F.col("_c").alias("c"), F.col("_b").alias("n"))).alias("_blocks"), F.sum("_rows").alias("_rows")))
    hot = hot_keys(sizes, "label", "_rows")
    members = spread_join(sized, sizes.drop("_rows"), "label", "sid", hot)
    members = members.select(F.xxhash64("label").alias("group"), "_c", "_blocks", "sid", "copies", *keys("first.doc", "first.none", "first.mark"))
    mine = own.withColumn("none", F.col("doc").isNull()).select("text", *keys("doc", "none", "mark"))
    texts = mine.join(members, KEY).dropDuplicates(KEY)
    texts = texts.select("group", "_c", "_blocks", "sid", "copies", "text")
    schema = T.StructType([*texts.schema.fields[:5], T.StructField("hashes", T.BinaryType())])
    dealt = class_blocks(texts.mapInArrow(lambda b: hashed(b, k), schema), "sid").select("group", "one", "two", "side", "sid", "copies", "hashes")
    found = written(dealt.repartition("group", "one", "two").sortWithinPartitions("group", "one", "two").mapInArrow(lambda b: decided(b, similarity), "u binary, v binary, links long"), "decided")
    dropped(sized, sizes, *tables)
    label = connected_components(found)
    return sets, found, label


def blank(own: DataFrame) -> DataFrame:
    """The rows without a word, which are in no set."""
    return own.where(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))


def classes(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, class_id (least id of the texts joined to it by links), n_links (other documents with a similarity
    of at least `similarity`, copies included), copy_id (least id with an equal shingle set) and n_copies (such rows)."""
    own = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"))
    rows = reused(sketched(own, k))
    sets, found, label = joined(own, rows, k, similarity)
    per_set = found.groupBy(F.col("u").alias("sid")).agg(F.sum("links").alias("links"))
    of_class = reused(label.join(sets.select("sid", "rep"), F.col("node") == F.col("sid")).select("sid", "label", "rep"))
    least = reused(of_class.groupBy("label").agg(F.min("rep").alias("class_id"), F.count("*").alias("_rows")))
    named = spread_join(of_class, least.drop("_rows"), "label", "sid", hot_keys(least, "label", "_rows")).join(per_set, "sid", "left").select("sid", "class_id", "links")
    facts = sets.select("sid", "rep", "copies").join(named, "sid", "left").select("sid", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rep").alias("copy_id"), F.col("copies").alias("n_copies"))
    known = spread_join(rows.select("doc", "sid"), facts, "sid", None, hot_keys(sets, "sid", "copies")).drop("sid")
    empty = blank(own).select("doc", F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"))
    return known.unionByName(empty).select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "class_id", "n_links", "copy_id", "n_copies")


def representatives(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark) of one text of each class, once: the id, null only where the class has no other, and the xxhash64 of the
    text; the least ones. Blank texts are of one class if text and id are equal."""
    own = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"))
    rows = reused(sketched(own, k))
    sets, _, label = joined(own, rows, k, similarity)
    dropped(rows)
    linked = sets.select("sid", "first").join(label, F.col("node") == F.col("sid"), "left")
    least = linked.groupBy(F.coalesce("label", "sid").alias("class")).agg(F.min("first").alias("first")).select("first.doc", "first.mark")
    return least.unionByName(blank(own).select("doc", "mark").distinct())
