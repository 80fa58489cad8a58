"""Operator 3: a convolutional text classifier for toxicity, trained in numpy.

Words (letters in lower case, other signs count as blanks) are hashed to embeddings: a word's is the sum of that of the
whole word and those of its first 3, 4, 6 and 8 bytes, so that unseen forms of a stem are met. Filters over 1, 2 and 3
words in a row are pooled by their greatest value over the whole text, and a linear layer gives the logit. One number of
each embedding starts as the smoothed log-odds of what it stands for; all weights are trained by gradient descent, in which only the
pooled places carry a gradient; what is used is the mean of the weights after each epoch of the second half. Hash places seen in fewer than three training texts share one embedding.

Thresholds are calibrated by language on the part CHECKED of the labelled rows that training does not see: a score is the sigmoid of the
logit less the threshold of the text's language, which is told from its words, so 0.5 is the cut in every language. With
fewer than 50 labelled rows, or if the rest would lack a label, training sees all; with fewer than 20 rows that it does not
see, thresholds are calibrated on all; languages with fewer than 10 toxic rows among these take the common threshold.

Learns from every row of every labelled id outside the held-out fold, in tasks: texts are counted by hash place; each epoch, tasks of about SHARD
rows start from the same weights and take their own steps, batch by batch, and a weight moves by the mean of what
the tasks that touched it moved it by; thresholds are read off counts of logits in steps of 1/STEPS. Nothing but counts and weights,
at most 2^PLACES_BITS embeddings, passes through the driver. Without both labels every score is 0. Null text is
empty; an empty text has no words and the score of the bias. Rows are scored one by one: repeated rows and ids and
further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import held_out, in_order, labelled_ids
from .scratch import dropped, reused
from .text import U, Chunk, chunks, mix, powers

#: Training rows that take their steps one after another.
SHARD = 8192
#: What tasks send of moved weights and of their squares is rounded to these parts of one.
GRAIN, SQUARE_GRAIN = 1 << 14, 1 << 20
#: Bits of the filter by which most unlabelled texts are passed over before they meet the labels.
FILTER_BITS = 26
PLACES_BITS = 22
#: What is hashed of a word: all of it, and so many of its first bytes.
PARTS = (0, 3, 4, 6, 8)
WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 8
EPOCHS, BATCH, RATE = 8, 32, 0.05
CHECKED = 0.3
LEAST_TEXTS = 3
#: Toxic rows from which a language has a threshold of its own.
LEAST_TOXIC = 10
#: Logits are counted in steps of 1/STEPS, up to FAR of either sign.
STEPS, FAR = 1024, 64
DENSE = sum(WIDTHS) * SIZE * FILTERS + 2 * len(WIDTHS) * FILTERS + 1
INNER = np.zeros(256, bool)
INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash places of each word's parts, -1 for one that it is too short for; number of words of each text)."""
    c = Chunk([])
    c.n, c.raw = len(texts), b" ".join(texts)
    raw = np.frombuffer(c.raw, np.uint8)
    # other signs count as blanks, so "word!!" and "word" are one
    c.buf = np.where(INNER[raw], LOWER[raw], np.uint8(0x20))
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    c.end = np.cumsum(size + 1) - 1
    c.begin = c.end - size
    c.words()
    h, (_, down) = c.prefix(), powers(len(c.buf) + 1)
    out = np.zeros((len(c.hash), len(PARTS)), np.int32)
    for k, part in enumerate(PARTS):
        stop = np.minimum(c.stop, c.start + part) if part else c.stop
        key = mix((h[stop] - h[c.start]) * down[c.start] + U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        out[:, k] = (key >> U(64 - PLACES_BITS)).astype(np.int32)
        if part:
            out[c.stop - c.start < part, k] = -1
    return out, c.counts


def numbered(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """(the numbers of each text's words, the hash places of each word)."""
    number: dict[int, int] = {}
    words, out = [], []
    for i in range(0, len(texts), 256):
        at, n = places(texts[i : i + 256])
        key = np.zeros(len(at), U)
        for k in range(len(PARTS)):
            key = mix(key ^ at[:, k].astype(np.int64).view(U))
        values, first, which = np.unique(key, return_index=True, return_inverse=True)
        own = np.empty(len(values), np.int32)
        for k, (v, f) in enumerate(zip(values.tolist(), first.tolist(), strict=True)):
            own[k] = number.setdefault(v, len(words))
            if own[k] == len(words):
                words.append(at[f])
        out += np.split(own[which], np.cumsum(n)[:-1])
    return out, np.array(words, np.int32).reshape(-1, len(PARTS))


def counted(texts: Iterable[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash places, the part of a word that each stands for, texts and toxic texts with it) of (places of words, toxic)."""
    number, bad = np.zeros(1 << PLACES_BITS, np.int32), np.zeros(1 << PLACES_BITS, np.int32)
    kind = np.zeros((1 << PLACES_BITS) + 1, np.int8)
    for words, toxic in texts:
        own = np.unique(words)
        own = own[own >= 0]
        number[own] += 1
        bad[own] += toxic
        for k in range(len(PARTS)):
            kind[words[:, k]] = np.maximum(kind[words[:, k]], k)
    known = np.flatnonzero(number)
    return known, kind[known], number[known], bad[known]


def toxic_weight(texts: int, toxic: int) -> float:
    return min(5.0, (texts - toxic) / max(1, toxic))


def step(p: np.ndarray, square: np.ndarray, g: np.ndarray, at=...) -> None:
    square[at] += g * g
    p[at] -= RATE * g / np.sqrt(square[at])


def best(steps: np.ndarray, toxic: np.ndarray, n: np.ndarray, default: float) -> float:
    """The middle of the cuts with most F1, where toxic[i] of n[i] texts have logits from steps[i]/STEPS to the next step."""
    if not 0 < toxic.sum() < n.sum():
        return default
    s, at = np.unique(steps, return_inverse=True)
    hit, above = (np.append(np.cumsum(np.bincount(at, x)[::-1])[::-1], 0) for x in (toxic, n))
    cuts = np.concatenate([[s[0] - STEPS], -((s[1:] + s[:-1]) // -2), [s[-1] + STEPS]]) / STEPS
    f1 = 2 * hit / (above + toxic.sum())
    most = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(cuts[most[len(most) // 2]])


def views(theta: np.ndarray) -> tuple:
    """Embeddings, filters and biases of each width, weights and bias of the last layer: parts of one table of weights."""
    n = len(theta) - -(-DENSE // SIZE)
    rest, at, out = theta[n:].reshape(-1), 0, []
    for shape in (*((w, SIZE, FILTERS) for w in WIDTHS), *[(FILTERS,)] * len(WIDTHS), (len(WIDTHS) * FILTERS,), ()):
        size = int(np.prod(shape))
        out.append(rest[at : at + size].reshape(shape))
        at += size
    return theta[:n], out[: len(WIDTHS)], out[len(WIDTHS) : -2], out[-2], out[-1]


class Model:
    def __init__(self, texts: list[np.ndarray] = (), y: np.ndarray = np.zeros(0), langs: list[str] = (), words: np.ndarray | None = None, seed: int = 7):
        """Untrained without texts. texts: the hash places of the words of each text, or with `words` their numbers in it."""
        if words is None:
            words = np.concatenate(texts) if len(texts) else np.zeros((0, len(PARTS)), np.int32)
            texts = np.split(np.arange(len(words)), np.cumsum([len(t) for t in texts])[:-1])
        rng = np.random.default_rng(seed)
        self.trained = bool(len(y)) and 0 < y.sum() < len(y)
        self.index = np.zeros((1 << PLACES_BITS) + 1, np.uint32)
        if not self.trained:
            return
        fit = rng.random(len(y)) >= CHECKED
        if y[fit].sum() in (0, fit.sum()) or len(y) < 50:
            fit[:] = True
        rows = np.flatnonzero(fit)
        self.begin(*counted((words[texts[i]], y[i] > 0) for i in rows), int(y[fit].sum()), int(fit.sum()))
        index = self.index[words]

        def ids(some) -> list[np.ndarray]:
            return [index[texts[i]] for i in some]

        mean, weight = np.zeros_like(self.theta), toxic_weight(len(y), y.sum())
        for epoch in range(EPOCHS):
            order = rng.permutation(rows)
            self.epoch(((ids(some), y[some]) for some in (order[a : a + BATCH] for a in range(0, len(order), BATCH))), weight)
            if epoch >= EPOCHS // 2:
                mean += (self.theta - mean) / (epoch - EPOCHS // 2 + 1)
        self.theta[...] = mean
        names = sorted(set(langs))
        n = np.zeros((len(self.e), len(names)))
        for i, name in enumerate(langs):
            n[:, names.index(name)] += np.bincount(ids([i])[0][:, 0], minlength=len(self.e))
        self.languages(names, n)
        check = np.flatnonzero(~fit) if (~fit).sum() >= 20 else np.arange(len(y))
        found = [self.stepped(ids(some), y[some] > 0) for some in (check[a : a + 256] for a in range(0, len(check), 256))]
        self.calibrate(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def begin(self, known: np.ndarray, kind: np.ndarray, number: np.ndarray, bad: np.ndarray, toxic: int, texts: int, seed: int = 7) -> None:
        """The weights before training. known: hash places; kind: the part of a word that each stands for; number, bad: texts
        and toxic texts with it; toxic, texts: of all."""
        rng = np.random.default_rng(seed)
        some = number >= LEAST_TEXTS
        known, kind, number, bad = (x[some] for x in (known, kind, number, bad))
        order = np.lexsort((known, -number))
        known, kind, n, bad = (x[order] for x in (known, kind, number, bad))
        self.trained = True
        self.index = np.zeros((1 << PLACES_BITS) + 1, np.uint32)
        self.index[known] = np.arange(1, len(known) + 1)
        odds = np.log((bad + 0.5) / (toxic + 1)) - np.log((n - bad + 0.5) / (texts - toxic + 1))
        self.theta = np.zeros((len(known) + 1 + -(-DENSE // SIZE), SIZE), np.float32)
        self.square = np.full_like(self.theta, 1e-2)
        self.e, self.w, self.b, self.v, self.c = views(self.theta)
        self.e[1:] = rng.normal(0, 0.1, (len(known), SIZE))
        self.e[np.arange(1, len(known) + 1), kind] = odds * n / (n + 3)
        for w in self.w:
            w[...] = rng.normal(0, 0.2, w.shape)
        for k in range(len(PARTS)):
            self.w[0][0, :, k] = 0
            self.w[0][0, k, k] = 1
        self.v[:] = rng.normal(0, 0.1, len(self.v))
        self.v[: len(PARTS)], self.c[...] = 1 / len(PARTS), -3.0

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k not in ("e", "w", "b", "v", "c")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if self.trained:
            self.e, self.w, self.b, self.v, self.c = views(self.theta)

    def stepped(self, ids: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the place of its language in names, its logit in steps, its label."""
        step = np.floor(np.clip(self.logits(ids).astype(np.float64), -FAR, FAR) * STEPS).astype(np.int64)
        return self.language(ids), step, np.asarray(toxic, bool)

    def calibrate(self, spoken: np.ndarray, step: np.ndarray, toxic: np.ndarray, n: np.ndarray | None = None) -> None:
        """The cut of each language. n: how many texts each entry stands for, else one."""
        n = np.ones(len(step), np.int64) if n is None else n
        self.cut = np.full(len(self.names), best(step, toxic * n, n, 0.0))
        for k in range(len(self.names)):
            own = spoken == k
            if (toxic * n)[own].sum() >= LEAST_TOXIC:
                self.cut[k] = best(step[own], (toxic * n)[own], n[own], self.cut[k])

    def convolved(self, ids: list[np.ndarray]):
        """Of each width: (activations, first place of each text, texts with a window)."""
        gap = np.zeros((max(WIDTHS) - 1, len(PARTS)), np.uint32)
        size = np.array([len(x) for x in ids])
        flat = np.concatenate([np.concatenate([x, gap]) for x in ids])
        start = np.cumsum(size + len(gap)) - size - len(gap)
        x = self.e[flat].sum(1)
        out = []
        for w, k, b in zip(WIDTHS, self.w, self.b, strict=True):
            n = len(flat) - w + 1
            z = x[:n] @ k[0] + b
            for j in range(1, w):
                z += x[j : n + j] @ k[j]
            out.append(z)
        return flat, start, size, out

    def pooled(self, ids: list[np.ndarray]):
        flat, start, size, conv = self.convolved(ids)
        h = np.zeros((len(ids), len(WIDTHS) * FILTERS), np.float32)
        full = np.flatnonzero(size)
        for k, z in enumerate(conv):
            # a text's windows end with its last word; the blank words behind keep it from the next
            edge = np.stack([start[full], start[full] + size[full]], 1).ravel()
            padded = np.concatenate([z, np.full((max(0, edge.max(initial=0) + 1 - len(z)), FILTERS), -1e9, np.float32)])
            if len(full):
                h[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(padded, edge)[::2]
        return flat, start, size, conv, np.maximum(h, 0)

    def logits(self, ids: list[np.ndarray]) -> np.ndarray:
        return self.pooled(ids)[4] @ self.v + self.c

    def epoch(self, batches: Iterable[tuple[list[np.ndarray], np.ndarray]], toxic: float) -> np.ndarray:
        """A step for each batch of (texts, labels); toxic: what a toxic text weighs. Gives which rows of theta moved."""
        touched = np.zeros(len(self.theta), bool)
        squares = views(self.square)
        for texts, y in batches:
            flat, start, size, conv, h = self.pooled(texts)
            p = 1 / (1 + np.exp(-(h @ self.v + self.c)))
            d = ((p - y) * np.where(y > 0, toxic, 1.0) / len(texts)).astype(np.float32)
            dh = d[:, None] * self.v * (h > 0)
            step(self.v, squares[3], h.T @ d + 1e-4 * self.v)
            self.c -= np.float32(RATE * d.sum())
            grads = []
            for k, (w, z) in enumerate(zip(WIDTHS, conv, strict=True)):
                top = np.zeros((len(texts), FILTERS), np.int64)
                for t in np.flatnonzero(size):
                    top[t] = start[t] + z[start[t] : min(start[t] + size[t], len(z))].argmax(0)
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                t, f = np.nonzero(g)
                if not len(t):
                    continue
                gw = np.zeros_like(self.w[k])
                for j in range(w):
                    word = flat[top[t, f] + j]
                    np.add.at(gw[j].T, f, g[t, f][:, None] * self.e[word].sum(1))
                    own = g[t, f][:, None] * self.w[k][j].T[f]
                    grads += [(word[:, part], own) for part in range(len(PARTS))]
                step(self.w[k], squares[1][k], gw + 1e-4 * self.w[k])
                step(self.b[k], squares[2][k], np.bincount(f, g[t, f], FILTERS).astype(np.float32))
            if grads:
                word, g = np.concatenate([x[0] for x in grads]), np.concatenate([x[1] for x in grads])
                own, at = np.unique(word, return_inverse=True)
                total = np.zeros((len(own), SIZE), np.float32)
                np.add.at(total, at, g)
                total[own == 0] = 0
                step(self.e, squares[0], total, own)
                touched[own] = True
            touched[len(self.e) :] = True
        return np.flatnonzero(touched)

    def languages(self, names: list[str], n: np.ndarray) -> None:
        """Smoothed word shares. n: how often the texts of each language have a whole word, by embedding."""
        self.names = names
        counts = n + 0.1
        counts[0] = 1
        self.spoken = np.log(counts / counts.sum(0)).astype(np.float32)
        self.spoken[0] = 0

    def language(self, ids: list[np.ndarray]) -> np.ndarray:
        return np.array([self.spoken[x[:, 0]].sum(0).argmax() if len(x) else 0 for x in ids], np.int64)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        ids = [self.index[t] for t in texts]
        x = self.logits(ids).astype(np.float64) - self.cut[self.language(ids)]
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def unpacked(batches: Iterable[pa.RecordBatch], shuffle: np.random.Generator | None = None) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """Texts of about a megabyte at a time, with their rows. shuffle: each batch in its order."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        texts, at, size = [], [], 0
        packed = b.column("packed")
        for i in range(b.num_rows) if shuffle is None else shuffle.permutation(b.num_rows).tolist():
            texts.append(unpack.decompress(packed[i].as_py()))
            at.append(i)
            size += len(texts[-1])
            if len(texts) == 8 * BATCH or size > 1 << 20:
                yield texts, b.take(pa.array(at))
                texts, at, size = [], [], 0
        if texts:
            yield texts, b.take(pa.array(at))


def split(texts: list[bytes]) -> list[np.ndarray]:
    at, n = places(texts)
    return np.split(at, np.cumsum(n)[:-1])


def labels_of(b: pa.RecordBatch) -> np.ndarray:
    return b.column("toxic").to_numpy(zero_copy_only=False)


def learned(rows: DataFrame) -> Model:
    """rows: packed, toxic, lang, fit (seen by training), read once a step."""
    context = rows.sparkSession.sparkContext
    one = rows.groupBy("fit", "lang").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("bad"))
    by_fit = {r.fit: (r.n, r.bad) for r in one.groupBy("fit").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()}
    n, toxic = (sum(x[k] for x in by_fit.values()) for k in (0, 1))
    if not 0 < toxic < n:
        return Model()
    fits, bad = by_fit.get(True, (0, 0))
    if bad in (0, fits) or n < 50:
        rows, fits, bad = rows.withColumn("fit", F.lit(True)), n, toxic
    seen = rows.where("fit")
    check = rows.where("NOT fit") if n - fits >= 20 else rows

    def count(batches):
        found = counted((words, t) for texts, b in unpacked(batches) for words, t in zip(split(texts), labels_of(b), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in found], names=["place", "kind", "n", "bad"])

    own = seen.select("packed", "toxic").mapInArrow(count, "place int, kind int, n int, bad int").groupBy("place")
    own = own.agg(F.max("kind").alias("kind"), F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= LEAST_TEXTS).toArrow()
    model = Model()
    model.begin(*(own.column(k).to_numpy().astype(np.int64) for k in ("place", "kind", "n", "bad")), bad, fits)
    del own
    index, mean, weight = context.broadcast(model.index), np.zeros_like(model.theta), toxic_weight(n, toxic)
    model.index = None
    shards = seen.select("packed", "toxic").coalesce(fits // SHARD + 1)
    moves = [*(f"p{k}" for k in range(SIZE)), "square"]
    for epoch in range(EPOCHS):
        sent = context.broadcast(model)

        def run(batches, sent=sent, epoch=epoch):
            own, places_ = sent.value, index.value
            before = own.theta, own.square
            own.theta, own.square = own.theta.copy(), own.square.copy()  # the next task of this worker starts from the same weights
            own.e, own.w, own.b, own.v, own.c = views(own.theta)

            def parts():
                for texts, b in unpacked(batches, np.random.default_rng([epoch, TaskContext.get().partitionId()])):
                    ids, y = [places_[t] for t in split(texts)], labels_of(b).astype(float)
                    yield from ((ids[a : a + BATCH], y[a : a + BATCH]) for a in range(0, len(ids), BATCH))

            at = own.epoch(parts(), weight)
            p = np.rint((own.theta[at] - before[0][at]) * GRAIN).astype(np.int32)
            square = np.rint((own.square[at] - before[1][at]).mean(1) * SQUARE_GRAIN).astype(np.int64)
            own.theta, own.square = before
            some = p.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(at[some].astype(np.int32)), *(pa.array(np.ascontiguousarray(p[some, k])) for k in range(SIZE)), pa.array(square[some])], names=["at", *moves])

        moved = shards.mapInArrow(run, "at int, " + ", ".join(f"p{k} int" for k in range(SIZE)) + ", square long")
        moved = moved.groupBy("at").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in moves))
        moved = moved.select("at", *((F.col(c) / F.col("n") / (GRAIN if c != "square" else SQUARE_GRAIN)).cast("float").alias(c) for c in moves)).toArrow()
        at = moved.column("at").to_numpy()
        for k in range(SIZE):
            model.theta[at, k] += moved.column(f"p{k}").to_numpy()
            model.square[at, k] += moved.column("square").to_numpy()
        sent.destroy()
        if epoch >= EPOCHS // 2:
            mean += (model.theta - mean) / (epoch - EPOCHS // 2 + 1)
    model.theta[...], model.square = mean, None
    # languages without a threshold of their own are one
    names = sorted(r.lang for r in check.groupBy("lang").agg(F.sum(F.col("toxic").cast("long")).alias("bad")).where(F.col("bad") >= LEAST_TOXIC).collect())
    number = {name: k for k, name in enumerate(names)}
    size = len(model.e)

    def words(batches):
        n = np.zeros((len(names) + 1, size), np.int64)
        for texts, b in unpacked(batches):
            at, count = places(texts)
            spoken = np.repeat([number.get(name, len(names)) for name in b.column("lang").to_pylist()], count)
            np.add.at(n.reshape(-1), spoken * size + index.value[at[:, 0]], 1)
        lang, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[lang, at])], names=["lang", "at", "n"])

    own = rows.select("packed", "lang").mapInArrow(words, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((size, len(names) + 1))
    n[own.column("at").to_numpy(), own.column("lang").to_numpy()] = own.column("n").to_numpy()
    model.languages(*((names, n[:, :-1]) if names and not n[:, -1].any() else ([*names, None], n)))
    sent = context.broadcast(model)

    def steps(batches):
        for texts, b in unpacked(batches):
            found = sent.value.stepped([index.value[t] for t in split(texts)], labels_of(b))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["spoken", "step", "toxic"])

    own = check.select("packed", "toxic").mapInArrow(steps, "spoken long, step long, toxic boolean").groupBy("spoken", "step", "toxic").agg(F.count("*").alias("n")).toArrow()
    model.calibrate(*(own.column(k).to_numpy() for k in ("spoken", "step", "toxic", "n")))
    model.index = index.value
    sent.destroy()
    index.destroy()
    return model


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label: str = "toxic") -> DataFrame:
    """Per row: id_col, held_out, score, predicted. With sample_bytes, texts of more than 1/8 of that, compressed, are not
    learned from."""
    kind = docs.select(id_col).union(labels.select(id_col)).schema[0].dataType  # equal ids of two types have unequal hashes
    some = labelled_ids(labels, label, id_col, folds, fold).withColumn("sample_id", F.col("sample_id").cast(kind))
    own = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("id"), held_out(id_col, folds, fold).alias("held_out"), F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"))

    # at most 2^FILTER_BITS bits: texts that they pass over have no label, the join decides on the others
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    own_bits = some.select(bit("sample_id").alias("bit")).groupBy(F.expr("bit div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 32))")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    bits[own_bits.column("word").to_numpy()] = own_bits.column("bits").to_numpy()
    filter_ = docs.sparkSession.sparkContext.broadcast(bits)

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            at = b.column("_bit").to_numpy()
            found = np.flatnonzero(filter_.value[at >> 5] >> (at & 31).astype(np.uint32) & 1)
            for rows, texts in chunks([b.take(pa.array(found))], "_text"):
                yield pa.RecordBatch.from_arrays([pa.array([packer.compress(t) for t in texts], pa.binary()), *rows.columns[1:-1]], names=["packed", "key", "lang", "_h", "_m"])

    learn = own.where("NOT held_out").withColumn("key", F.col("id").cast(kind))
    on = F.col("key") == F.col("sample_id")
    n = int(learn.join(some, on).count() * (1 - CHECKED)) // SHARD + 1
    packed = learn.select("_text", "key", "_lang", *in_order("key", "_text", "_lang"), bit("key").alias("_bit"))
    packed = packed.mapInArrow(pack, T.StructType([T.StructField("packed", T.BinaryType()), T.StructField("key", kind), T.StructField("lang", T.StringType()), T.StructField("_h", T.LongType()), T.StructField("_m", T.LongType())]))
    if sample_bytes is not None:
        packed = packed.where(F.octet_length("packed") <= sample_bytes // 8)
    fit = F.pmod(F.xxhash64("_h", F.lit("fit")), F.lit(1000)) >= int(1000 * CHECKED)
    # dealt out once, for the join and for training; labels grow with the texts and are not sent to all tasks
    rows = packed.repartition(n, "key").join(some.repartition(n, "sample_id").hint("merge"), on).select("packed", (F.col("label") > 0).alias("toxic"), "lang", fit.alias("fit"), "_h", "_m")
    rows = reused(rows.sortWithinPartitions("_h", "_m").drop("_h", "_m"))
    model = learned(rows)
    dropped(rows)
    filter_.destroy()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        for b, texts in chunks(batches, "_text", 1 << 19):
            at, n = places(texts)
            s = sent.value.scores(np.split(at, np.cumsum(n)[:-1]))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(s), pa.array(s >= 0.5).cast(pa.int32())], names=schema.names)

    return own.mapInArrow(score, schema)
