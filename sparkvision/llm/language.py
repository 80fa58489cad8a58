"""Operator 5: language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams for n of 1, 2 and 3 (letters in lower case, all else a blank), hashed; the kernel of
two texts is the mean over n of the normalised number of n-grams that both have. LANDMARKS training texts span the
Nyström approximation, in which one ridge regression per language is solved. Texts are scored in blocks by two matrix
products: presence by landmarks, then kernel values by weights.

Scores of a text sum to 1, whatever it is, so the greatest says nothing of a text in no language or in one that was not
learned. On request known_share tells them: the share of a text's distinct trigrams (digits as one sign of their own) that
stand in at least KNOWN_IN of the training texts of the language it was given. A language with fewer than KNOWN_FROM
training texts cannot be judged so, and the share is 1.

Learns from at most SAMPLE ids with a text and a language, chosen by a hash of the id, and at most four times as many rows. Null texts and texts without a
letter are `und` with score 0; so is every text if there is nothing to learn from. Rows are scored one by one: repeated
rows and ids and further columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import first_rows, held_out, in_order
from .text import chunks

SAMPLE = 4000
LANDMARKS = 96
RIDGE = 1e-3
#: Hash places for n-grams of 1, 2 and 3 bytes.
PLACES = (256, 4096, 16384)
FROM = np.cumsum([0, *PLACES])
BLOCK = 64
LETTER = regex.compile(r"\p{L}")
FOLD = np.full(256, 0x20, np.uint8)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[0x80:] = np.arange(0x80, 0x100)
KNOWN_IN, KNOWN_FROM = 0.03, 10
SPELT = FOLD.copy()
SPELT[ord("0") : ord("9") + 1] = ord("0")


def presence(texts: list[bytes], fold: np.ndarray = FOLD) -> np.ndarray:
    """One row of 0 and 1 for each text."""
    out = np.zeros((len(texts), FROM[-1]), np.float32)
    buf = np.frombuffer(b"   ".join(texts) + b"   ", np.uint8)
    b = fold[buf]
    b[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)] += 0x20
    size = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    base = np.repeat(np.arange(len(texts)) * FROM[-1], size)[: len(b)]
    left = np.repeat(np.cumsum(size), size)[: len(b)] - np.arange(len(b))
    flat = out.ravel()
    code = b.astype(np.uint32)
    for n, places in enumerate(PLACES):
        if n:
            code = code[:-1] | b[n:].astype(np.uint32) << np.uint32(8 * n)
        at = code if n == 0 else (code * np.uint32(0x9E3779B1)) >> np.uint32(33 - places.bit_length())
        own = left[: len(at)] > n  # a text's n-grams end with the blanks behind it
        flat[base[: len(at)][own] + FROM[n] + at[own]] = 1
    return out


def trigrams(texts: list[bytes]) -> np.ndarray:
    """The places of the trigrams that known_share counts, one row of 0 and 1 for each text."""
    return presence(texts, SPELT)[:, FROM[2] :]


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows whose product is the kernel."""
    for n in range(len(PLACES)):
        part = x[:, FROM[n] : FROM[n + 1]]
        part /= np.sqrt(np.maximum(1, part.sum(1, keepdims=True)) * len(PLACES))
    return x


class Model:
    def __init__(self, bits: np.ndarray, langs: list[str], spelt: np.ndarray | None = None):
        """bits, spelt: packed rows of presence and of trigrams of the training texts."""
        self.langs = sorted(set(langs))

        def rows(at) -> np.ndarray:
            return normalised(np.unpackbits(bits[at], axis=1, count=int(FROM[-1])).astype(np.float32))

        # landmarks: in turn from each language, so that rare ones are spanned as well
        turn: dict[str, int] = {}
        order = sorted(range(len(langs)), key=lambda i: (turn.setdefault(langs[i], 0), turn.update({langs[i]: turn[langs[i]] + 1}))[0])
        z = rows(order[:LANDMARKS])
        values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
        keep = values > 1e-6 * max(values.max(), 1e-12)
        half = vectors[:, keep] / np.sqrt(values[keep])
        f = np.concatenate([rows(slice(i, i + 256)) @ z.T for i in range(0, len(bits), 256)]).astype(np.float64) @ half
        target = np.array([[float(a == b) for b in self.langs] for a in langs])
        self.mean = target.mean(0)
        weights = np.linalg.solve(f.T @ f + RIDGE * len(f) * np.eye(f.shape[1]), f.T @ (target - self.mean))
        self.landmarks, self.weights = np.ascontiguousarray(z.T), (half @ weights).astype(np.float32)

        if spelt is not None:
            own = [spelt[np.array(langs) == a] for a in self.langs]
            seen = [sum(np.unpackbits(x[i : i + 256], axis=1).sum(0, dtype=np.int64) for i in range(0, len(x), 256)) for x in own]
            self.known = np.array([(n >= max(1, KNOWN_IN * len(x))) | (len(x) < KNOWN_FROM) for n, x in zip(seen, own, strict=True)], np.float32)

    def known_share(self, texts: list[bytes], lang: np.ndarray) -> np.ndarray:
        """lang: the place in langs of each text's language."""
        x = trigrams(texts)
        return (x @ self.known.T)[np.arange(len(texts)), lang] / np.maximum(1, x.sum(1))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return normalised(presence(texts)) @ self.landmarks @ self.weights + self.mean.astype(np.float32)


def fit(docs: DataFrame, folds: int, fold: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spelling: bool = False) -> Model | None:
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    ids = own.where(~held_out("id", folds, fold)).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    some = own.join(F.broadcast(ids), "id").select("text", "lang", *in_order("id", "text", "lang"))  # at most `sample` ids

    def run(batches):
        for rows, texts in chunks(batches, "text", 1 << 18):
            packed = np.packbits(presence(texts).astype(bool), axis=1)
            spelt = np.packbits(trigrams(texts).astype(bool), axis=1) if spelling else np.zeros((len(texts), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in packed], pa.binary()), rows.column(1), pa.array([p.tobytes() for p in spelt], pa.binary()), rows.column(2), rows.column(3)], names=["bits", "lang", "spelt", "_h", "_m"])

    rows = first_rows(some.mapInArrow(run, "bits binary, lang string, spelt binary, _h long, _m long"), 4 * sample)
    rows = sorted(rows.select("bits", "lang", "spelt").collect())
    if not rows:
        return None
    bits, spelt = (np.stack([np.frombuffer(r[c], np.uint8) for r in rows]) for c in ("bits", "spelt"))
    return Model(bits, [r.lang for r in rows], spelt if spelling else None)


def identified(docs: DataFrame, model: Model | None, folds: int, fold: int, keep: list[str] = (), id_col: str = "doc_id", text_col: str = "text", spelling: bool = False) -> DataFrame:
    """Per row: id_col, held_out, lang_pred, score, with spelling also known_share (the model must have learned it), and the
    columns of `keep`."""
    own = docs.select(F.col(text_col).alias("_text"), F.col(id_col), held_out(id_col, folds, fold).alias("held_out"), *[F.col(c) for c in keep if c != id_col])
    schema = T.StructType([*own.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("known_share", T.DoubleType())] * spelling])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own_model = sent.value
        for rows, texts in chunks(batches, "_text", 1 << 20):
            lang, score, known = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if LETTER.search(t.decode())] if own_model else []
            for i in range(0, len(at), BLOCK):
                some = at[i : i + BLOCK]
                own_texts = [texts[j] for j in some]
                s = own_model.scores(own_texts)
                lang[some] = np.array(own_model.langs, object)[s.argmax(1)]
                if spelling:
                    known[some] = own_model.known_share(own_texts, s.argmax(1))
                score[some] = np.clip(s.max(1), 0, 1)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(lang, pa.string()), pa.array(score), *[pa.array(known)] * spelling], names=schema.names)

    return own.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 3, fold: int = 1, keep: list[str] = (), spelling: bool = False) -> DataFrame:
    return identified(docs, fit(docs, folds, fold, spelling=spelling), folds, fold, keep, spelling=spelling)
