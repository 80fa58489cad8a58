"""Operators 11 and 12 against plain versions in numpy and Python integers."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkvision.llm import negatives, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, doc_id string, id int, x int, n int, component int, cluster int, score int, a_id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3, 4, 5, 6, 7) for r in rows], SCHEMA)


def vectors(n, size, seed, centres=6):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, size))
    v = c[rng.integers(0, centres, n)] + rng.normal(0, 0.4, (n, size))
    return (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32).tolist()


def mined(rows, **limits):
    return negatives.hard_negatives(queries.relabelled(rows), **limits)


def odd_rows(n=420, size=8):
    rng = random.Random(2)
    v = vectors(n, size, 1)
    rows = [(i, v[i], rng.randrange(10)) for i in range(n)]
    rows += [(i, v[300], 4) for i in range(n, n + 60)]  # copies of one vector
    rows += [(1000, v[1], 3), (1100, v[2], 3), (1000, v[1], 3), (1000, v[5], 3), (5, v[5], 1), (5, v[5], 1)]
    rows += [(1200, None, 1), (1201, [None] * size, 1), (1300, [float("nan")] * size, 1), (1400, [*v[0][:-1], float("inf")], 1), (1500, v[3], None), (None, v[4], 2), (1600, [*v[6][:-1], None], 2)]
    rows += [(1700, [0.0] * size, 5), (1800, [], 5), (1801, v[7][:3], 6), (1900, [-0.0] * size, 7), (2000, [-x for x in v[0]], 8)]
    return rows


def clean(rows, size):
    for i, v, label in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            yield i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (size - len(v)), label


def test_whitening(spark):
    rows = odd_rows()
    got = whitening.whitened(frame(spark, rows)).collect()
    own = [(i, x) for i, x, _ in clean(rows, 8)]
    fit = np.array(sorted({tuple(x) for _, x in own}))
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, w = np.linalg.eigh(v)
    assert len(got) == 4 * len(own) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    want = Counter((i, int(((n * np.array(x) - s) ** 2).sum())) for i, x in own)
    by = {k: sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == k) for k in (1, 2, 3, 4)}
    for k, mine in by.items():
        assert Counter((r.vec_id, r.deviation) for r in got if r.component == k) == want
        assert {round(r.explained / (e[-k] / e.sum()), 9) for r in got if r.component == k} == {1.0}
        plain = sorted((str(i), int(((n * np.array(x) - s) ** 2).sum()), float((np.array(x) - s / n) @ w[:, -k] / np.sqrt(e[-k]))) for i, x in own)
        sign = 1 if abs(sum(a[2] * b[2] for a, b in zip(mine, plain, strict=True))) == sum(a[2] * b[2] for a, b in zip(mine, plain, strict=True)) else -1
        assert all(a[2] == pytest.approx(sign * b[2], abs=1e-7) for a, b in zip(mine, plain, strict=True))


def test_whitening_in_parts(spark, monkeypatch):
    rows = odd_rows()
    want = sorted(map(str, whitening.whitened(frame(spark, rows)).collect()))
    monkeypatch.setattr(whitening, "PAIRS", 7)
    assert len(sorted(map(str, whitening.whitened(frame(spark, rows)).collect()))) == len(want)


def test_whitening_without_variance(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    got = whitening.whitened(frame(spark, [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(got, key=str)] == [(1, 1, 0, 0.0, 0.0, 1.0)] * 2 + [(2, 1, 0, 0.0, 0.0, 1.0)] * 2
    line = whitening.whitened(frame(spark, [(i, [i / 4, i / 4, 1e30 if i == 9 else 0.0], 1) for i in range(10)])).collect()
    assert len(line) == 30 and {r.deviation for r in line} == {None}  # beyond 64 bits


def plain_negatives(rows, size):
    own = []
    for i, x, label in clean(rows, size):
        if i is not None and label is not None:
            own.append((i, x, (label + 1) % 10 if i % 7 == 0 else label))
    out = Counter()
    for a_id, a, label in {(i, tuple(x), label) for i, x, label in own if i % 100 == 0}:
        scored = sorted((-sum(p * q for p, q in zip(a, x, strict=True)), i, other) for i, x, other in own)
        for s, p, _ in [r for r in scored if r[2] == label and r[1] != a_id][:5]:
            found = [r for r in scored if r[2] != label and -30 * s <= -100 * r[0] <= -90 * s][:10]
            for k, r in enumerate(found):
                out[a_id, p, k + 1, r[1], -s, -r[0]] += 1
    return out


@pytest.mark.parametrize("clusters, shelf", [(1, 10_000), (7, 40), (60, 25)])
def test_negatives(spark, clusters, shelf):
    rows = odd_rows()
    got = Counter(tuple(r) for r in mined(frame(spark, rows), clusters=clusters, shelf=shelf).collect())
    want = plain_negatives(rows, 8)
    assert sum(want.values()) > 100 and got == want


def test_negatives_are_few(spark):
    assert mined(frame(spark, [])).count() == 0
    assert mined(frame(spark, [(100, [1.0], 1)])).count() == 0
    two = mined(frame(spark, [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [1.0, 0.0], 2), (4, [0.2, 0.0], 2)]))
    assert [tuple(r) for r in two.collect()] == [(100, 1, 1, 2, 65536, 32768)]


def test_negatives_of_large_numbers(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 6) for _ in range(4)], i % 3) for i in range(0, 300, 5)]
    got = Counter(tuple(r) for r in mined(frame(spark, rows), clusters=5, shelf=10).collect())
    assert got == plain_negatives(rows, 4)


def test_clusters_are_skipped(spark):
    """Clusters beyond the window, or below the tenth score, are not visited."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * (np.eye(8)[np.arange(800) % 8] + rng.normal(0, 0.01, (800, 8)))).astype(np.int64)
    centroids = negatives.k_means(x.astype(float), 8)
    own = negatives.nearest(x.astype(float), centroids)
    radius = np.array([np.sqrt(((x[own == c] - centroids[c]) ** 2).sum(1)).max(initial=0) for c in range(8)])
    found = negatives.Clusters(centroids, radius, np.bincount(own, minlength=8), 100, "<i8")
    low, high = (np.full((800, 1), v) for v in (40_000, negatives.MOST))
    may = found.eligible(x, low, high)
    assert may.mean() < 0.3  # an anchor's own direction
    score = x @ x.T
    assert all(may[i, own[j]] for i, j in np.argwhere(score >= 40_000))
    assert not found.eligible(x, high, low).any()
    label = np.arange(800) // 8 % 2
    rows = [(i, (v / 256).tolist(), int(label[i])) for i, v in enumerate(x)]
    assert Counter(tuple(r) for r in mined(frame(spark, rows), clusters=8, shelf=100).collect()) == plain_negatives(rows, 8)


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op11_hard_negatives(spark, sf_dir).collect()) == plain_negatives(rows, 64)
