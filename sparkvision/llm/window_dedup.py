"""Operator 4: substring dedup by super-k-mers of words.

A window is 20 consecutive words. Windows sharing a minimiser go as one packed string to its bucket, where sorting
brings equal windows together: a window is sorted by two 64-bit hashes, each made of other hashes of its words' bytes, so it
is known by 128 bits. A bucket beyond SLICE bytes is sorted in parts of the hash range, for each of which its stretches are
read again, so memory does not grow with the bucket. Each word of a window whose words also start earlier (smaller id, or
the same document and an earlier place) is removed.

Null text has no words; an empty or short text loses none. Rows with the same id count as one document, so equal rows
do not remove each other's words; a null id sorts before all others. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .superwindows import Received, Shape, found_spans, keyed, union, unpacked, with_spans, word_powers
from .text import SPACE, U, Chunk, content_hash, mix, spread

SLICE = 4 << 20
OTHER = 0x8BB84B93962EACC9


def later(doc, mark, start, units, some, first):
    """Of a chunk's equal stretches all but the earliest are removed whole. Several rows of one id may hold the earliest: those of
    different texts all travel, as an earlier one elsewhere removes each of them."""
    away = (doc[some] != doc[first]) | (start[some] != start[first])
    copy = np.append(False, (first[1:] == first[:-1]) & (mark[some][1:] == mark[some][:-1]))[: len(some)]
    go = some[away]
    return (doc[go], mark[go], start[go], start[go] + units[go]), some[away | copy]


def hashes(r: Received, i: int, j: int, window: int) -> tuple[np.ndarray, ...]:
    """(one hash, another hash, stretch, place in the document) of each window of the stretches i:j."""
    c = Chunk(r.texts(i, j)).words()
    owner = np.repeat(np.arange(i, j), r.windows[i:j])
    at = spread(c.first[:-1], r.windows[i:j])
    up, down = word_powers(len(c.hash) + 1)
    out = []
    for word in (c.hash, content_hash(c.buf, c.start, c.stop, OTHER)):
        sums = np.zeros(len(word) + 1, U)
        np.cumsum(word * up[: len(word)], out=sums[1:])
        out.append(mix((sums[at + window] - sums[at]) * down[at]))
    return *out, owner, r.start[owner] + at - c.first[owner - i]


def judged(r: Received, window: int):
    for i, j, large in r.slices(SLICE):
        total = np.append(0, np.cumsum(r.size[i:j]))
        cut = [i, *(i + np.searchsorted(total, np.arange(SLICE, total[-1], SLICE))).tolist(), j] if large else [i, j]
        parts_ = len(cut) - 1
        for part in range(parts_):
            found = []
            for a, b in zip(cut, cut[1:], strict=False):
                if a < b:
                    own = hashes(r, a, b, window)
                    mine = own[0] % U(parts_) == U(part)
                    found.append(own if parts_ == 1 else tuple(x[mine] for x in own))
            yield from later_windows(r, *map(np.concatenate, zip(*found, strict=True)), window)


def later_windows(r: Received, h: np.ndarray, check: np.ndarray, owner: np.ndarray, place: np.ndarray, window: int):
    """(doc, mark, lo, hi) of the runs of windows that are not the first of their kind."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return
    some = order[np.append(False, same) | np.append(same, False)]
    some = some[np.lexsort((place[some], r.doc[owner[some]], check[some], h[some]))]
    doc, at = r.doc[owner[some]], place[some]
    head = np.append(True, (h[some][1:] != h[some][:-1]) | (check[some][1:] != check[some][:-1]))
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    lost = some[(doc != doc[first]) | (at != at[first])]
    if not len(lost):
        return
    lost = lost[np.lexsort((place[lost], owner[lost]))]
    o, at = owner[lost], place[lost]
    a = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (o[1:] != o[:-1])))
    b = np.append(a[1:], len(lost)) - 1
    yield r.doc[o[a]], r.mark[o[a]], at[a], at[b] + window


def remove_repeated_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id_col, n_words, n_removed, kept_sha256 (of the kept words joined by a space); `with_text` adds that text
    as `kept` and the removed ranges of words as `spans`."""
    own = keyed(docs, id_col, text_col)
    shape = Shape(True, window, max(1, window // 8))
    spans = found_spans(own, shape, later, lambda r: judged(r, window))
    joined = with_spans(own, spans)
    pair = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    schema = T.StructType([own.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.StringType()), T.StructField("spans", pair)] if with_text else [])])
    blanks = bytes(np.flatnonzero(SPACE).tolist())
    table = bytes.maketrans(blanks, b" " * len(blanks))

    def apply(batches):
        for b in batches:
            sizes, gone, sums, kept, where = [], [], [], [], []
            for text, found in zip(unpacked(b), b.column(2).to_pylist(), strict=True):
                words = text.translate(table).split()
                ranges = union(found, len(words))
                left, at = [], 0
                for lo, hi in ranges:
                    left += words[at:lo]
                    at = hi
                left += words[at:]
                out = b" ".join(left)
                sizes.append(len(words))
                gone.append(len(words) - len(left))
                sums.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    kept.append(out.decode())
                    where.append([{"lo": x, "hi": y} for x, y in ranges])
            cols = [b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            if with_text:
                cols += [pa.array(kept, pa.string()), pa.array(where, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(apply, schema).select("id.*", *schema.names[1:])


#: The same rows in SQL; ids must be unique.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, list_aggregate(words[i : i + 19], 'string_agg', ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
firsts AS (SELECT win, min({'d': doc_id, 'i': i}) AS f FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM windows JOIN firsts USING (win) WHERE {'d': doc_id, 'i': i} <> f),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
