"""Operator 8: byte-pair encoding and decoding with forced boundaries.

Two bytes that stand side by side in no token of the vocabulary can never be merged into one token, so each such place
in a word is a certain cut. The fragments between cuts are encoded independently, each different one once a task, and
the ids are concatenated. Words, fragments and merges are handled as numpy arrays over a few megabytes of text; words are
told apart by a 64-bit hash of their code points.

Supported: word-level vocabularies in the `tokenizers` JSON format whose normaliser is NFC, white space and lower case,
whose pre-tokeniser keeps contractions, letters, single digits and other signs, and whose words end in `</w>`.

Null text counts as empty; an empty text has no ids and decodes to an empty string. Repeated rows and repeated ids give
one row each. Columns other than the two named are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import U, chunks, content_hash, spread

#: Fixed values of the format: the contractions that are words of their own, and the mark at a word's end.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WORD_END = "</w>"
OTHER, LETTER, DIGIT, BLANK, SPECIAL = 0, 1, 2, 3, 4
#: A code point that no valid text holds stands for the first special token, the next one for the second, and so on.
STAND_IN = 0xD800
#: Different words that a worker remembers; beyond it starts anew.
MEMORY = 400_000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    points = [*range(STAND_IN), *range(0xE000, 0x110000)]
    every, at = "".join(map(chr, points)), np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[at[m.start() : m.end()]] = kind
    out[STAND_IN:0xE000] = SPECIAL
    return out


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """The merges as arrays, the table of byte pairs that may be inside a token, and each token's text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.specials = [(t["content"], t["id"]) for t in spec["added_tokens"]]
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + WORD_END] for c in letters], np.int64)
        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            raw = [byte_of[c] for c in token.removesuffix(WORD_END)]
            for a, b in zip(raw, raw[1:], strict=False):
                self.joined[a, b] = True
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pair_key, self.made = left << 20 | right, made
        self.slots = np.full(1 << 21, -1, np.int32)
        order = np.arange(len(made))[::-1]
        self.slots[self.slot(self.pair_key[order])] = order
        missed = np.flatnonzero(self.slots[self.slot(self.pair_key)] != np.arange(len(made)))
        missed = missed[np.argsort(self.pair_key[missed])]
        self.missed_key, self.missed = self.pair_key[missed], missed
        text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials}
        size = max(text) + 1
        self.token_bytes = [(text.get(i, "") + " ").encode() for i in range(size)]
        self.token_len = np.array([len(t) for t in self.token_bytes])
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_pool = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.forget()

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(U) * U(0x9E3779B97F4A7C15) >> U(43)).astype(np.int64)

    def forget(self) -> None:
        self.known, self.known_at, self.known_len = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.pooled = np.zeros(1 << 16, np.uint16 if len(self.token_len) <= 1 << 16 else np.uint32), 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges, or a large number."""
        key = a << 20 | b
        found = self.slots[self.slot(key)].astype(np.int64)
        wrong = np.flatnonzero((found >= 0) & (self.pair_key[found] != key))
        found[found < 0] = 1 << 40
        if len(wrong):
            at = np.minimum(np.searchsorted(self.missed_key, key[wrong]), len(self.missed_key) - 1)
            found[wrong] = np.where(self.missed_key[at] == key[wrong], self.missed[at], 1 << 40) if len(self.missed_key) else 1 << 40
        return found

    def fragments(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of each fragment, lowest rank first: (ids, number of ids of each fragment)."""
        owner = np.repeat(np.arange(len(size)), size)
        live = np.ones(len(symbols), bool)
        out_ids, out_owner = [], []
        rank = np.full(len(symbols), 1 << 40)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            of = np.repeat(best, np.diff(np.append(first, len(owner))))
            done = of == 1 << 40
            if done.any():
                out_ids.append(symbols[done])
                out_owner.append(owner[done])
                symbols, owner, rank, of = symbols[~done], owner[~done], rank[~done], of[~done]
                if not len(symbols):
                    break
            hit = rank == of
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # "aaa": of neighbouring hits every other one, from the left
                run = np.cumsum(np.append(True, np.diff(at) != 1)) - 1
                start = at[np.flatnonzero(np.append(True, np.diff(at) != 1))]
                at = at[(at - start[run]) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            live = np.ones(len(symbols), bool)
            live[at + 1] = False
            moved = np.cumsum(live) - 1
            symbols, owner, rank = symbols[live], owner[live], rank[live]
            at = moved[at]
            for i in (at, at[at > 0] - 1):
                more = i[i < len(symbols) - 1]
                more = more[owner[more] == owner[more + 1]]
                rank[i] = 1 << 40
                rank[more] = self.rank(symbols[more], symbols[more + 1])
        if not out_ids:
            return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
        ids, owner = np.concatenate(out_ids), np.concatenate(out_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(size))

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Encode words not seen yet: cut each at its forced boundaries, encode the different fragments, concatenate."""
        buf = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter((len(w) for w in words), np.int64, len(words))
        stop = np.cumsum(size)
        cut = np.zeros(len(buf), bool)
        cut[:-1] = ~self.joined[buf[:-1], buf[1:]]
        cut[stop - 1] = True
        ends = np.zeros(len(buf), bool)
        ends[stop - 1] = True
        until = np.flatnonzero(cut) + 1
        frag_size = np.diff(until, prepend=0)
        last = ends[until - 1]
        raw = buf.tobytes()
        number: dict[tuple[bytes, bool], int] = {}
        index = np.fromiter((number.setdefault((raw[b - n : b], e), len(number)) for b, n, e in zip(until.tolist(), frag_size.tolist(), last.tolist(), strict=True)), np.int64, len(until))
        keys = list(number)
        flat = np.frombuffer(b"".join(k[0] for k in keys), np.uint8)
        sizes = np.fromiter((len(k[0]) for k in keys), np.int64, len(keys))
        symbols = self.inner[flat]
        end = np.fromiter((k[1] for k in keys), bool, len(keys))
        at = np.cumsum(sizes)[end] - 1
        symbols[at] = self.last[flat[at]]
        ids, counts = self.fragments(symbols, sizes)
        starts = np.cumsum(counts) - counts
        word_ids = ids[spread(starts[index], counts[index])]
        per_word = np.add.reduceat(counts[index], np.append(0, np.flatnonzero(last)[:-1] + 1))
        while self.pooled + len(word_ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.pooled : self.pooled + len(word_ids)] = word_ids
        at = self.pooled + np.cumsum(per_word) - per_word
        self.pooled += len(word_ids)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.known_at, self.known_len = np.concatenate([self.known_at, at])[order], np.concatenate([self.known_len, per_word])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        clean = []
        for t in texts:
            for i, (name, _) in enumerate(self.specials):
                if name in t:
                    t = t.replace(name, chr(STAND_IN + i))
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")
            clean.append(t.lower())
        lengths = np.fromiter((len(t) for t in clean), np.int64, len(clean))
        point = np.frombuffer("\n".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(lengths + 1) - lengths - 1
        if not len(point):
            return np.zeros(0, self.pool.dtype), np.zeros(len(texts), np.int64)
        kind = classes()[point]
        new = np.ones(len(point) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == SPECIAL)
        quote = np.flatnonzero((point == 0x27) & new[:-1])
        if len(quote):
            padded = np.append(point, np.zeros(3, np.uint32))
            free = np.ones(len(quote), bool)
            for c in CONTRACTIONS:
                here = free.copy()
                for j, x in enumerate(c[1:], 1):
                    here &= padded[quote + j] == ord(x)
                free &= ~here
                new[quote[here] + 1] = False
                new[np.minimum(quote[here] + len(c), len(point))] = True
        start = np.flatnonzero(new[:-1])
        stop = np.append(start[1:], len(point))
        keep = kind[start] != BLANK
        start, stop = start[keep], stop[keep]
        word = content_hash(point, 4 * start, 4 * stop)
        different, inverse = np.unique(word, return_inverse=True)
        first = np.zeros(len(different), np.int64)
        first[inverse] = np.arange(len(word))
        if len(self.known) > MEMORY:
            self.forget()
        at = np.searchsorted(self.known, different)
        at[at == len(self.known)] = 0
        fresh = np.flatnonzero(self.known[at] != different) if len(self.known) else np.arange(len(different))
        special = kind[start[first[fresh]]] == SPECIAL if len(fresh) else np.zeros(0, bool)
        plain = fresh[~special]
        if len(plain):
            whole = "\n".join(clean)
            self.learn(different[plain], [whole[a:b].encode() for a, b in zip(start[first[plain]].tolist(), stop[first[plain]].tolist(), strict=True)])
        at = np.minimum(np.searchsorted(self.known, different), max(0, len(self.known) - 1))
        if len(self.known):
            pool_at, pool_len = self.known_at[at], self.known_len[at]
        else:
            pool_at, pool_len = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64)
        pool = self.pool[: self.pooled]
        if len(fresh) and special.any():  # after the pool, this time only
            those = fresh[special]
            pool_at, pool_len = pool_at.copy(), pool_len.copy()
            pool_at[those], pool_len[those] = self.pooled + np.arange(len(those)), 1
            pool = np.append(pool, np.array([self.specials[p - STAND_IN][1] for p in point[start[first[those]]].tolist()], pool.dtype))
        n = pool_len[inverse]
        ids = pool[spread(pool_at[inverse], n)]
        total = np.append(0, np.cumsum(n))
        cut = np.searchsorted(start, np.append(begin, len(point) + 1))
        return ids, np.diff(total[cut])

    def decoded(self, ids: np.ndarray) -> bytes:
        """The tokens with a space between them, as this format's decoder-less decode writes them."""
        ids = ids.astype(np.int64)
        return self.token_pool[spread(self.token_at[ids], self.token_len[ids])].tobytes()[:-1]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(batches, path: str, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the ids of each row."""
    own = vocabulary(path)
    for rows, texts in chunks(batches, text, 1 << 20):
        ids, counts = own.encode([t.decode() for t in texts])
        yield rows, np.split(ids, np.cumsum(counts)[:-1])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256; with `ids` and
    `decoded` also the ids (array<int>) and the decoded text. `path` must name the vocabulary on every executor."""
    kept = docs.select(id_col, text_col)
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * decoded
    schema = T.StructType([kept.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *extra])

    def run(batches):
        own = vocabulary(path)
        for rows, each in encoded(batches, path, text_col):
            plain = [own.decoded(x) for x in each]
            cols = [rows.column(0), pa.array([len(x) for x in each], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]), pa.array([hashlib.sha256(x).hexdigest() for x in plain])]
            if ids:
                cols.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
            if decoded:
                cols.append(pa.array([x.decode() for x in plain]))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return kept.mapInArrow(run, schema)
