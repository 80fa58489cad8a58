"""Words, hashes and windows of many texts at once, as numpy arrays over their joined UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: The white space of the words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD_BASE = U(0xD1342543DE82EF95)
#: Bytes that are handled at once; a longer single text is a chunk of its own.
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


#: Bytes from which on a range is hashed by itself.
LONG = 256
#: The first 0 to 8 bytes of a little-endian block.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def content_hash(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each range of bytes, block by block of eight: unlike the differences of prefix sums below it has no pattern of
    different long ranges that always agree."""
    raw = np.ascontiguousarray(buf).view(np.uint8)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    block = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    size = stop - start
    out = mix(size.astype(U) * BASE ^ U(seed))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        out[live] = mix(out[live] ^ (block[start[live] + at] & FIRST_BYTES[left]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(memoryview(padded)[start[i] : stop[i]], seed)
    return out


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * BASE)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept up to a chunk's size."""
    up = _powers.get("up")
    if up is None or len(up) < n:
        m = max(n, CHUNK + CHUNK // 4)
        up, down = np.full(m, BASE), np.full(m, BASE_INVERSE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if m > 4 * CHUNK:
            return up, down
        _powers["up"], _powers["down"] = up, down
    return up, _powers["down"]


class Chunk:
    """Some texts joined by a space: `buf`, `begin`/`end` of each text, and lazily their words."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.raw = b" ".join(texts)
        self.buf = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes

    def prefix(self) -> np.ndarray:
        """Prefix sums: the hash of buf[i:j] is (h[j] - h[i]) * BASE**-i. For short ranges, or where contents are compared too."""
        up, _ = powers(len(self.buf) + 1)
        h = np.zeros(len(self.buf) + 1, U)
        np.cumsum(BYTE_VALUES[self.buf] * up[: len(self.buf)], out=h[1:])
        return h

    def words(self, hashed: bool = True) -> Chunk:
        """Sets start, stop (bytes), first (index of each text's first word, and the end), doc and hash of each word."""
        gap = np.ones(len(self.buf) + 2, bool)
        gap[1:-1] = SPACE[self.buf]
        change = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.stop = change[::2], change[1::2]
        self.first = np.append(np.searchsorted(self.start, self.begin), len(self.start))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)
        if hashed:
            self.hash = content_hash(self.buf, self.start, self.stop)
        return self

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of each run of k words; a text of fewer words has one, of all its words; one without words none."""
        w, n = self.hash, len(self.hash)
        out = np.zeros(max(0, n - k + 1), U)
        for j in range(k):
            out = out * WORD_BASE + w[j : j + len(out)]
        inside = self.doc[: len(out)] == self.doc[k - 1 :] if n >= k else np.zeros(0, bool)
        hashes, docs = mix(out[inside]), self.doc[: len(out)][inside]
        few = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(few):
            own = np.zeros(len(few), U)
            for i, d in enumerate(few):
                v = 0
                for x in w[self.first[d] : self.first[d + 1]].tolist():
                    v = (v * int(WORD_BASE) + x) & 0xFFFFFFFFFFFFFFFF
                own[i] = v
            hashes, docs = np.concatenate([hashes, mix(own + self.counts[few].astype(U))]), np.concatenate([docs, few])
        return hashes, docs


def column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Texts as bytes, null as empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `limit` bytes of text each."""
    for batch in batches:
        texts = column(batch, text)
        at, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t) + 1
        if texts:
            yield batch.slice(at), texts[at:]


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ..."""
    if not len(length):
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours: one pass forward and one back over blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    if w == 1:
        return x.copy()
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    fore = np.minimum.accumulate(padded.reshape(blocks, w), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(blocks, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in the component of each of n nodes under the links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        a, b = a[open_], b[open_]
    return label
