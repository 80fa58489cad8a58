"""Operator 7: a generalised additive model with pairwise interactions for text quality.

Each text gives a row of numbers. Every number is cut into bins at quantiles of the training rows. Boosting goes round
the numbers in turn: a tree of at most four leaves on one number's bins is fitted to the logistic gradient and added,
shrunk, to that number's lookup table. The pairs whose quadrants explain most of what is left then get tables of their
own in the same way. A score is the sigmoid of a sum of table entries, looked up for whole blocks of texts.

Learns from at most SAMPLE labelled ids, chosen by a hash of the id, and at most twice as many rows; without labels every score is 0.5. Null text is
empty, and an empty text has a score like any other. Rows are scored one by one: repeated rows and ids and further
columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules import SYMBOL, WINDOW, by_doc, covered, twice
from .samples import first_rows, held_out, in_order, label_sample
from .superwindows import word_powers
from .text import Chunk, U, chunks, content_hash, mix

SAMPLE = 20_000
BINS, COARSE = 32, 8
ROUNDS, RATE = 150, 0.1
PAIRS, PAIR_ROUNDS = 6, 60
FEATURES = ("words", "word_length", "symbols", "upper", "digits", "marks", "beyond_ascii", "lines", "equal_lines", "repeated", "distinct", "blanks", "ends_in_mark", "short_words", "longest_word", "line_length")


def kinds() -> dict[str, np.ndarray]:
    b = np.arange(256)
    upper = (b >= 65) & (b <= 90)
    digit = (b >= 48) & (b <= 57)
    letter = upper | (b >= 97) & (b <= 122) | (b >= 128)
    blank = np.isin(b, [32, *range(9, 14)])
    return {"symbols": SYMBOL, "upper": upper, "digits": digit, "marks": ~letter & ~digit & ~blank, "beyond_ascii": b >= 192, "blanks": blank}


KINDS = kinds()


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    c = Chunk(texts).words()
    n, words = c.n, np.maximum(c.counts, 1)
    size = np.maximum(c.end - c.begin, 1)
    out = {"words": np.log1p(c.counts), "word_length": np.bincount(c.doc, c.stop - c.start, n) / words}
    for name, table in KINDS.items():
        total = np.append(0, np.cumsum(table[c.buf], dtype=np.int32))
        out[name] = (total[c.end] - total[c.begin]) / size
    feed = np.flatnonzero(c.buf == 0x0A)
    start, stop = np.sort(np.concatenate([c.begin, feed + 1])), np.sort(np.concatenate([c.end, feed]))
    line = content_hash(c.buf, start, stop)
    line_doc = np.searchsorted(c.begin, start, side="right") - 1
    full = stop > start
    line, line_doc = line[full], line_doc[full]
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    out["lines"] = np.log1p(lines)
    out["equal_lines"] = by_doc(twice(line, line_doc) == 2, line_doc, n) / lines
    out["line_length"] = np.log1p(size / lines)
    up, wdown = word_powers(len(c.hash) + 1)
    sums = np.zeros(len(c.hash) + 1, U)
    np.cumsum(c.hash * up[: len(c.hash)], out=sums[1:])
    at = np.flatnonzero(c.doc[: max(0, len(c.doc) - WINDOW + 1)] == c.doc[WINDOW - 1 :]) if len(c.doc) >= WINDOW else np.zeros(0, np.int64)
    again = at[twice(mix((sums[at + WINDOW] - sums[at]) * wdown[at]), c.doc[at]) > 0]
    out["repeated"] = by_doc(covered(again, np.full(len(again), WINDOW), len(c.hash)), c.doc, n) / words
    out["distinct"] = by_doc(twice(c.hash, c.doc) < 2, c.doc, n) / words
    out["ends_in_mark"] = np.bincount(c.doc, KINDS["marks"][c.buf[c.stop - 1]] if len(c.stop) else None, n) / words
    out["short_words"] = np.bincount(c.doc, c.stop - c.start <= 3, n) / words
    longest = np.zeros(n)
    np.maximum.at(longest, c.doc, c.stop - c.start)
    out["longest_word"] = np.log1p(longest)
    return np.stack([out[f] for f in FEATURES], 1)


def leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on the bins: each bin's step."""

    def cut(lo: int, hi: int) -> int | None:
        gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(gl):
            return None
        gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        best = int(gain.argmax())
        return lo + best + 1 if gain[best] > 1e-9 else None

    edges, out = [0, len(g)], np.zeros(len(g))
    for _ in range(2):
        edges = sorted({*edges, *(x for a, b in zip(edges, edges[1:], strict=False) if (x := cut(a, b)) is not None)})
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes at once: (gain, step of each cell)."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = gc[:-1, :-1], hc[:-1, :-1]
    parts = [(a, b), (gc[:-1, -1:] - a, hc[:-1, -1:] - b), (gc[-1:, :-1] - a, hc[-1:, :-1] - b)]
    parts.append((gc[-1, -1] - sum(p[0] for p in parts), hc[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(x**2 / (y + 1) for x, y in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.zeros_like(g)
    for (x, y), cells in zip(parts, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        step[cells] = x[i, j] / (y[i, j] + 1)
    return float(gain[i, j]), step


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])] if len(x) else [np.zeros(0)] * len(FEATURES)
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(np.unique(y)) < 2:
            return
        bins = self.binned(x)
        f = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for i, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                g, h = np.bincount(bins[i], y - p, len(table)), np.bincount(bins[i], p * (1 - p), len(table))
                step = RATE * leaves(g, h)
                table += step
                f += step[bins[i]]
        coarse = [self.coarse(b, len(t)) for b, t in zip(bins, self.tables, strict=True)]
        p = 1 / (1 + np.exp(-f))
        cell = lambda i, j, v: np.bincount(coarse[i] * COARSE + coarse[j], v, COARSE * COARSE).reshape(COARSE, COARSE)
        ranked = sorted(((quadrants(cell(i, j, y - p), cell(i, j, p * (1 - p)))[0], i, j) for i in range(len(bins)) for j in range(i)), reverse=True)
        self.pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in ranked[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-f))
                step = RATE * quadrants(cell(i, j, y - p), cell(i, j, p * (1 - p)))[1]
                table += step
                f += step[coarse[i], coarse[j]]

    def binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]

    def coarse(self, bins: np.ndarray, n: int) -> np.ndarray:
        return bins * COARSE // n

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        f = np.full(len(x), self.base)
        for b, table in zip(bins, self.tables, strict=True):
            f += table[b]
        for i, j, table in self.pairs:
            f += table[self.coarse(bins[i], len(self.tables[i])), self.coarse(bins[j], len(self.tables[j]))]
        return 1 / (1 + np.exp(-f))


def fit(docs: DataFrame, labels: DataFrame, folds: int, fold: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    some = label_sample(labels, label, id_col, folds, fold, sample)
    # at most `sample` ids, so they may be sent to all tasks, and the joined rows to the driver
    own = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("id")).join(F.broadcast(some), F.col("id") == F.col("sample_id")).select("_text", "label", *in_order("id", "_text"))

    def measure(batches):
        for rows, texts in chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([rows.column(1), pa.array([v.tobytes() for v in features(texts)], pa.binary()), rows.column(2), rows.column(3)], names=["label", "x", "_h", "_m"])

    rows = first_rows(own.mapInArrow(measure, "label int, x binary, _h long, _m long"), 2 * sample)
    found = sorted((r.label, bytes(r.x)) for r in rows.collect())
    x = np.array([np.frombuffer(r[1]) for r in found]).reshape(-1, len(FEATURES))
    return Model(x, np.array([float(r[0] > 0) for r in found]))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7, sample: int = SAMPLE, keep: list[str] = (), id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """Per row: id_col, the columns of `keep`, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, fold, sample, id_col, text_col, label))
    own = docs.select(F.col(text_col).alias("_text"), F.col(id_col), *[F.col(c) for c in keep if c != id_col], held_out(id_col, folds, fold).alias("held_out"))
    schema = T.StructType([*own.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        for rows, texts in chunks(batches, "_text"):
            s = sent.value.scores(features(texts))
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(s), pa.array(s >= threshold).cast(pa.int32())], names=schema.names)

    return own.mapInArrow(score, schema)
