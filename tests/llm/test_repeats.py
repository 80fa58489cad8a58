"""Operators 4 and 10 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sparkvision.llm import suffix_dedup, superwindows, window_dedup

from .conftest import SCHEMA, prose


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def brute_windows(rows, window):
    words = [(-(1 << 63) if r[0] is None else r[0], re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())) for r in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for (i, w), r in zip(words, rows, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone[k : k + window] = True
        out.append((r[0], len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def brute_bytes(rows, window):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    number = defaultdict(int)
    for _, t in texts:
        for k in range(len(t) - window + 1):
            number[t[k : k + window]] += 1
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if number[t[k : k + window]] > 1:
                gone[k : k + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    return out


def corpus(seed, n=60):
    """Texts with passages in common, inner repeats, few words, copies with changes."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else prose(rng, rng.randint(0, 30)) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.2:
            parts += [rng.choice(["ab ", "x y ", "q"]) * rng.randint(5, 60)]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(parts), "en", "s", 0))
    return rows + [(n + i, rows[i][1], "en", "s", 0) for i in range(5)]


def as_set(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize(("seed", "window"), [(1, 20), (2, 8), (3, 3)])
def test_windows(spark, seed, window):
    rows = corpus(seed)
    got = window_dedup.remove_repeated_windows(spark.createDataFrame(rows, SCHEMA).repartition(3), window)
    assert as_set(got) == sorted(map(str, brute_windows(rows, window)))


@pytest.mark.parametrize(("seed", "window"), [(1, 100), (2, 40), (3, 25)])
def test_bytes(spark, seed, window):
    rows = corpus(seed)
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3), window)
    assert as_set(got) == sorted(map(str, brute_bytes(rows, window)))


def test_shards_are_merged(spark, monkeypatch):
    """One minimiser over several shards: what is single in one is found in another."""
    shape = superwindows.Shape(False, 30, 6)
    rows = corpus(7, 40)
    own = superwindows.keyed(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    batch = own.toArrow().combine_chunks().to_batches()[0].select(["text", "doc", "mark"])
    blobs = [x for b in superwindows.send([batch], shape, np.zeros(0, np.uint64), 1, suffix_dedup.every) for x in b.column(1).to_pylist() if x]

    def judged():
        r = superwindows.Received(blobs, shape)
        r.minimum = np.zeros_like(r.minimum)
        found = defaultdict(set)
        for doc, mark, lo, hi in suffix_dedup.judged(r, 30):
            for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
                found[d] |= set(range(a, b))
        return found

    whole = judged()
    monkeypatch.setattr(suffix_dedup, "SHARD", 500)
    assert whole and judged() == whole


def stretches_of(texts, window):
    """What one task receives if all windows have one minimiser, and the bytes that brute force removes, by text."""
    batch = pa.RecordBatch.from_pydict({"text": texts, "doc": range(len(texts)), "mark": range(len(texts))})
    shape = superwindows.Shape(False, window, max(1, min(32, window // 8)))
    blobs = [x for b in superwindows.send([batch], shape, np.zeros(0, np.uint64), 1, lambda doc, mark, start, units, some, first: (tuple(x[:0] for x in (doc, mark, start, start)), some[:0])) for x in b.column(1).to_pylist() if x]
    r = superwindows.Received(blobs, shape, every=True)
    r.minimum = np.zeros_like(r.minimum)
    number = Counter(t[k : k + window] for t in map(str.encode, texts) for k in range(len(t) - window + 1))
    gone = [{k + x for k in range(len(t) - window + 1) if number[t[k : k + window]] > 1 for x in range(window)} for t in map(str.encode, texts)]
    return r, gone


def removed_by(r, window, n):
    found = [set() for _ in range(n)]
    for doc, _, lo, hi in suffix_dedup.judged(r, window):
        for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
            found[d] |= set(range(a, b))
    return found


def common_line(seed, n):
    """A line that all texts hold between words of their own, and passages that some of them share."""
    rng = random.Random(seed)
    line, passages = prose(rng, 8), [prose(rng, 30) for _ in range(4)]
    return [f"{prose(rng, 20)}\n{line}\n{rng.choice(passages) if rng.random() < 0.3 else prose(rng, 20)} {prose(rng, rng.randint(0, 5))}" for _ in range(n)]


def same_few_lines(seed, n):
    """Nothing but three lines in any order, and runs of one letter."""
    rng = random.Random(seed)
    lines = [prose(rng, 3) for _ in range(3)]
    return ["\n".join(rng.choice(lines) for _ in range(rng.randint(2, 12))) for _ in range(n)] + ["q" * rng.randint(50, 400) for _ in range(n)]


@pytest.mark.parametrize(("texts", "window"), [(common_line, 100), (common_line, 40), (same_few_lines, 60), (same_few_lines, 30)])
def test_large_minimisers(monkeypatch, texts, window):
    """Dealt out anew by the next minimiser, or merged where windows hold the same few runs of bytes."""
    monkeypatch.setattr(suffix_dedup, "SHARD", 4000)
    for seed in range(3):
        r, gone = stretches_of(texts(seed, 80), window)
        assert any(gone) and removed_by(r, window, len(gone)) == gone


def test_shards_of_one_minimiser_are_looked_up(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 1000)
    monkeypatch.setattr(suffix_dedup, "TILE", 3)
    for texts in (common_line, same_few_lines):
        r, gone = stretches_of(texts(4, 30), 40)
        found = [set() for _ in gone]
        for doc, _, lo, hi in [r.merged(40), *suffix_dedup.looked_up(r, 0, len(r.minimum), 40)]:
            for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
                found[d] |= set(range(a, b))
        assert found == gone


def test_work_on_a_large_minimiser_follows_its_bytes(monkeypatch):
    """A line in many texts: suffix arrays over no more than its stretches' bytes, and no pairs of shards that meet."""
    monkeypatch.setattr(suffix_dedup, "SHARD", 10_000)
    built, pairs = [], []
    monkeypatch.setattr(suffix_dedup.Shard, "built", lambda self, window, f=suffix_dedup.Shard.built: built.append(len(self.buf)) or f(self, window))
    monkeypatch.setattr(suffix_dedup, "met", lambda *a, f=suffix_dedup.met: pairs.append(1) or f(*a))
    for n in (200, 800):
        r, gone = stretches_of(common_line(9, n), 100)
        assert r.size.sum() > 8 * suffix_dedup.SHARD
        built.clear()
        assert removed_by(r, 100, n) == gone
        assert not pairs and sum(built) <= 2 * r.size.sum()


def test_a_frequent_line_at_the_query_s_window(monkeypatch):
    """Windows of 400 bytes around a line of 4000 texts, in shards of the usual size: none is looked up in another's array."""
    monkeypatch.setattr(suffix_dedup.Shard, "holds", lambda *a: pytest.fail("windows are looked up"))
    rng = random.Random(3)
    line = prose(rng, 10)
    texts = [f"{rng.randbytes(150).hex()}\n{line}\n{rng.randbytes(150).hex()}" for _ in range(4000)]
    texts += [t[10:] for t in texts[:50]]
    r, _ = stretches_of(texts, 400)
    assert r.size.sum() > 4 * suffix_dedup.SHARD
    found = removed_by(r, 400, len(texts))
    whole = [{*range(len(t))} for t in texts]
    assert found[50:4000] == [set()] * 3950 and found[4000:] == whole[4000:]
    assert found[:50] == [x - {*range(10)} for x in whole[:50]]


def test_suffix_order_and_prefixes():
    rng = random.Random(2)
    text = bytes(rng.choice(b"ab") for _ in range(300))

    class One:
        size, windows = np.array([len(text)]), np.array([1])

        @staticmethod
        def texts(i, j):
            return [text]

    s = suffix_dedup.Shard(One, 0, 1, 400)
    assert s.sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    common = s.common_prefixes()
    for a, b in zip(s.sa, s.sa[1:], strict=False):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert common[b] == n


def test_odd_rows(spark, odd, odd_rows, none):
    got = window_dedup.remove_repeated_windows(odd)
    assert as_set(got) == sorted(map(str, brute_windows(odd_rows, 20)))
    got = suffix_dedup.remove_repeated_bytes(odd, 400)
    assert as_set(got) == sorted(map(str, brute_bytes(odd_rows, 400)))
    assert window_dedup.remove_repeated_windows(none).count() == suffix_dedup.remove_repeated_bytes(none).count() == 0


def test_kept_text_and_spans(odd):
    for r in suffix_dedup.remove_repeated_bytes(odd, 400, with_text=True, keep=["lang"]).collect():
        assert len(r.spans) == r.n_spans and sum(s.hi - s.lo for s in r.spans) == r.n_removed
        assert r.n_removed or sha(r.kept.encode()) == r.kept_sha256


def test_shards_meet_across_tiles(spark, monkeypatch):
    """More shards than are held at once, and buckets of words beyond a slice."""
    monkeypatch.setattr(suffix_dedup, "SHARD", 400)
    monkeypatch.setattr(suffix_dedup, "TILE", 3)
    for shape, judge, module, brute in ((superwindows.Shape(False, 30, 6), suffix_dedup.judged, suffix_dedup.every, brute_bytes), (superwindows.Shape(True, 6, 2), window_dedup.judged, window_dedup.later, brute_windows)):
        monkeypatch.setattr(window_dedup, "SLICE", 300)
        rows = [(i, t, *rest) for i, (_, t, *rest) in enumerate(corpus(8, 30))]
        own = superwindows.keyed(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
        batch = own.toArrow().combine_chunks().to_batches()[0].select(["text", "doc", "mark"])
        sent = [b for b in superwindows.send([batch], shape, np.zeros(0, np.uint64), 1, module)]
        gone = defaultdict(set)
        for b in sent:
            for d, lo, hi, blob in zip(*(b.column(x).to_pylist() for x in ("doc", "lo", "hi", "blob")), strict=True):
                if blob is None:
                    gone[d] |= set(range(lo, hi))
        r = superwindows.Received([x for b in sent for x in b.column("blob").to_pylist() if x], shape)
        r.minimum = np.zeros_like(r.minimum)
        for doc, _, lo, hi in judge(r, shape.window):
            for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
                gone[d] |= set(range(a, b))
        assert {i: len(gone[i]) for i in range(len(rows))} == {row[0]: row[2] for row in brute(rows, shape.window)}


def test_hot_minimisers_and_condensed_tasks(spark, monkeypatch):
    """A passage in every document, its runs counted as frequent, and tasks that make equal stretches one as they read."""
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(0, 25)) + " " + passage + " " + prose(rng, rng.randint(0, 25)), "en", "s", 0) for i in range(120)]
    monkeypatch.setattr(superwindows, "CONDENSE", 500)
    monkeypatch.setattr(superwindows, "SHARE", 1 << 12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    hot, _ = superwindows.frequent(superwindows.keyed(df, "doc_id", "text"), superwindows.Shape(False, 100, 12))
    assert len(hot)
    assert as_set(suffix_dedup.remove_repeated_bytes(df, 100)) == sorted(map(str, brute_bytes(rows, 100)))
    assert as_set(window_dedup.remove_repeated_windows(df, 20)) == sorted(map(str, brute_windows(rows, 20)))


def test_inbox_keeps_different_stretches_only(spark):
    shape = superwindows.Shape(False, 30, 6)
    rows = corpus(9, 40)
    own = superwindows.keyed(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    batch = own.toArrow().combine_chunks().to_batches()[0].select(["text", "doc", "mark"])
    blobs = [x for b in superwindows.send([batch], shape, np.zeros(0, np.uint64), 1, suffix_dedup.every) for x in b.column("blob").to_pylist() if x]
    box = superwindows.Inbox(shape, suffix_dedup.every, 2000)
    spans = [s for _ in range(50) for s in box.add(list(blobs))]
    assert spans and box.size < 4 * sum(map(len, blobs)) + 4000


@pytest.mark.parametrize("same", [None, 5])
def test_many_rows_without_or_with_one_id(spark, same):
    """Unlike texts keep what is theirs alone, though all ids are null or equal."""
    rng = random.Random(6)
    passage = prose(rng, 80)
    rows = [(same, prose(rng, rng.randint(20, 70)) + (" " + passage if i % 7 == 0 else ""), "en", "s", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert as_set(suffix_dedup.remove_repeated_bytes(df, 100)) == sorted(map(str, brute_bytes(rows, 100)))
    got = window_dedup.remove_repeated_windows(df, 20, with_text=True).collect()
    ends = [r.kept.endswith(passage) for r in got]
    # one document: the passage stays where it starts first, in one row or in all that it starts at that place in
    want = {r[1] for r in rows if not r[1].endswith(passage)}
    assert sum(r.n_removed == 0 for r in got) == len(want) + sum(ends)
    assert sorted(r.n_words for r in got) == sorted(len(r[1].split()) for r in rows)
    firsts = min(len(r[1].split()) for r in rows if r[1].endswith(passage))
    assert {r.n_words for r, e in zip(got, ends, strict=True) if e} == {firsts}


@pytest.mark.parametrize("hot", [False, True])
def test_rows_of_one_id_that_hold_a_passage_at_one_place(spark, monkeypatch, hot):
    """Of such rows in one task none stands for the others: an earlier place in another task removes the passage in all."""
    rng = random.Random(11)
    passage = prose(rng, 80)
    late = [(i % 2, prose(rng, 21) + " " + passage, "en", "s", 0) for i in range(12)]
    early = [(i % 2, prose(rng, 20) + " " + passage, "en", "s", 0) for i in range(2)]
    alone = [(i % 2, prose(rng, 30), "en", "s", 0) for i in range(6)]
    monkeypatch.setattr(superwindows, "SHARE", 1 << 12 if hot else 4)
    monkeypatch.setattr(superwindows, "CONDENSE", 500 if hot else 1 << 20)
    rows = [*late, *late, *early, *alone]
    tasks = [[*late, *late], [*early, *alone]]
    df = spark.createDataFrame(spark.sparkContext.union([spark.sparkContext.parallelize(task, 1) for task in tasks]), SCHEMA)
    found, _ = superwindows.frequent(superwindows.keyed(df, "doc_id", "text"), superwindows.Shape(True, 20, 2))
    assert bool(len(found)) == hot
    assert as_set(window_dedup.remove_repeated_windows(df, 20)) == sorted(map(str, brute_windows(rows, 20)))
    assert as_set(suffix_dedup.remove_repeated_bytes(df, 100)) == sorted(map(str, brute_bytes(rows, 100)))


def test_bytes_of_the_whole_table(spark):
    """Every row of sf0.1 against hashes of all its 400-byte windows."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not Path(path).exists():
        pytest.skip("no test tables")
    window, base = 400, 0x2545F4914F6CDD1D
    docs = spark.read.parquet(path)
    own = docs.select("doc_id", "text").toArrow().sort_by("doc_id")
    texts = [(t or "").encode() for t in own["text"].to_pylist()]
    buf, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), size)
    value = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)[buf]
    up, down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(len(buf), x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))
    sums = np.append(np.uint64(0), np.cumsum(value * up[:-1]))
    at = np.flatnonzero(doc[: 1 - window] == doc[window - 1 :])
    _, which, times = np.unique((sums[at + window] - sums[at]) * down[at], return_inverse=True, return_counts=True)
    change = np.zeros(len(buf) + 1, np.int64)
    np.add.at(change, at[times[which] > 1], 1)
    np.add.at(change, at[times[which] > 1] + window, -1)
    gone = np.cumsum(change)[:-1] > 0
    edge = np.append(0, np.cumsum(size))
    want = []
    for i, (id_, t) in enumerate(zip(own["doc_id"].to_pylist(), texts, strict=True)):
        g = gone[edge[i] : edge[i + 1]]
        want.append((id_, len(t), int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum()), sha(np.frombuffer(t, np.uint8)[~g].tobytes())))
    assert sum(w[2] for w in want) > 1_000_000
    assert as_set(suffix_dedup.remove_repeated_bytes(docs)) == sorted(map(str, want))
