"""Operators 1 and 6 against brute force, and connected components."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkvision.llm import fingerprints, ngram_join
from sparkvision.llm.graph import connected_components

from .conftest import SCHEMA, prose


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    links = [[] for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) / len(a | b) >= 0.8 - 1e-12:
                links[i].append(j)
                links[j].append(i)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(links):
            for j in own:
                if rows[label[j]][0] < rows[label[i]][0]:
                    label[i], changed = label[j], True
    return sorted((r[0], rows[label[i]][0], len(links[i])) for i, r in enumerate(rows))


def near(rng, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 5, 6, 30, 120, 300])) for _ in range(60)]
    texts += [near(rng, rng.choice(texts[:60]), rng.randint(0, 4)) for _ in range(120)]
    base = prose(rng, 200)
    texts += [near(rng, base, rng.randint(0, 5)) for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = ngram_join.classes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_classes(rows)


def test_large_buckets_are_split_and_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", 4)
    monkeypatch.setattr(ngram_join, "DEEP_LIMIT", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 8)
    rng = random.Random(9)
    base, line = prose(rng, 150), prose(rng, 30)
    texts = [near(rng, base, rng.randint(0, 4)) for _ in range(50)] + [line + " " + prose(rng, 20) for _ in range(40)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = ngram_join.classes(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_classes(rows)


def test_runs_reach_the_recall():
    assert ngram_join.runs_for(0.9999, 1) == 10 and ngram_join.runs_for(0.9999, 3) == 20


def test_odd_rows(odd, odd_rows, none):
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.classes(odd).collect()}
    assert {(1, 1, 2), (2, 1, 2), (3, 1, 2), (7, 7, 2), (8, 7, 2), (4, 4, 0), (5, 5, 0), (6, 6, 0), (None, None, 0)} <= got
    assert ngram_join.classes(odd).count() == len(odd_rows)
    assert ngram_join.classes(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(rng.choice([120, 200, 300]))]
    label = {x: x for a, b in links for x in (a, b) if a != b}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(got) == len(label) and {r.node: r.label for r in got} == label


def sketch_of(text, fraction=fingerprints.FRACTION):
    """The signed hashes below the fraction of the range, one after the other over the words of each shingle."""
    out = set()
    for words in shingles(text):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        h -= (h >> 63) << 64
        if h < -(1 << 63) + fraction * (1 << 64):
            out.add(h)
    return out


def likeness(a, b, same_words):
    """(containment of the smaller, Jaccard similarity); of two empty sketches by the texts' words."""
    both = len(a & b)
    if not a or not b:
        return (1.0, 1.0) if not a and not b and same_words else (0.0, 0.0)
    return both / min(len(a), len(b)), both / len(a | b)


def test_fingerprints(spark):
    """Against sketches, edited texts and likenesses made one by one, and against the true similarity."""
    rng = random.Random(4)
    rows = [(i * 7, prose(rng, rng.choice([0, 3, 20, 200, 900])), "en", "s", 0) for i in range(50)]
    rows += [(400 + i, rows[i][1] + " and more", "en", "s", 0) for i in range(0, 50, 3)]
    texts = [r[1] for r in rows]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for k, (i, text, *_) in enumerate(rows):
        q, after = len(text) // 4, texts[(k + 1) % len(texts)]
        edited = text[: len(text) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        one, two, three = sketch_of(text), sketch_of(edited), sketch_of(after)
        for s, said in ((one, r.fingerprint), (two, r.edited_fingerprint)):
            assert said == "".join(f"{h & (1 << 64) - 1:016X}" for h in sorted(s))
        assert (r.near_edited, r.jaccard_edited) == pytest.approx(likeness(one, two, text.split() == edited.split()))
        assert (r.near_next, r.jaccard_next) == pytest.approx(likeness(one, three, text.split() == after.split()))
        a, b = shingles(text), shingles(edited)
        assert len(a | b) <= 32 or abs(r.jaccard_edited - len(a & b) / len(a | b)) < 0.25
    assert all(got[i].fingerprint == got[j].fingerprint for i, t, *_ in rows for j, u, *_ in rows if t == u)


def test_sketches_merge(spark):
    rng = random.Random(6)
    texts = [prose(rng, 300) for _ in range(3)]
    own = spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprints.sketch(F.col("text")).alias("s"))
    whole = set(own.select(fingerprints.merged(F.col("s")).alias("m")).first().m)
    assert whole == set().union(*(set(r.s) for r in own.collect()))


def test_fingerprints_of_odd_rows(odd, odd_rows, none):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == len(odd_rows) and fingerprints.fingerprints(none).count() == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    plan = fingerprints.fingerprints(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("least", [5, 1000])
def test_many_null_ids_and_hot_copies(spark, monkeypatch, least):
    """A third of all rows has no id, a third is one text; small hot keys are dealt out as well."""
    from sparkvision.llm import graph, skew

    monkeypatch.setattr(skew, "LEAST", least)
    monkeypatch.setattr(skew, "HOT", 20)
    monkeypatch.setattr(graph, "FEW", least)
    rng = random.Random(12)
    base = prose(rng, 60)
    rows = [(None if i % 3 else i, near(rng, base, 1) if i % 3 == 1 else base if i % 3 == 2 else prose(rng, 40), "en", "s", 0) for i in range(150)]
    sets = [shingles(r[1]) for r in rows]
    links = [sum(i != j and bool(a) and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = ngram_join.classes(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(r[0]), n) for r, n in zip(rows, links, strict=True))


def test_recall_on_the_larger_table(spark):
    """The links of 200 documents of sf0.1 with all its rows."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not Path(path).exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    sets = {r.doc_id: shingles(r.text or "") for r in docs.select("doc_id", "text").collect()}
    holds = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holds[x].append(i)
    want = {}
    for i in [i for i in sets if i % 50 == 0]:
        both = Counter(j for x in sets[i] for j in holds[x] if j != i)
        want[i] = sum(n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) for j, n in both.items())
    got = {r.doc_id: r.n_links for r in ngram_join.classes(docs).collect()}
    assert len(got) == len(sets) and sum(want.values()) > 50
    assert {i: got[i] for i in want} == want
