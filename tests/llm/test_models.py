"""Operators 2, 3, 5 and 7: counts against brute force, models by accuracy on rows they did not learn from."""

import bisect
import random
import re
import zlib
from collections import Counter

import numpy as np

from sparkvision.llm import language, quality_model, quality_rules, toxicity

from .conftest import SCHEMA, prose

WORDS = {"en": ("th", "er", "on", "an"), "de": ("ich", "sch", "ung", "ber"), "fr": ("eau", "ou", "tre", "ment")}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def cover(k):
        n = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return len({i + j for i in range(len(w) - k + 1) if n[tuple(w[i : i + k])] > 1 for j in range(k)})

    lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    longest = 0
    while cover(longest + 1):
        longest += 1
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), cover(5), cover(quality_rules.MIN_REPEAT), longest


def test_measures():
    rng = random.Random(1)
    texts = ["", " ", "a", "a a a a a a", "x\nx\n\n \nx\r\n", "#é|<> ü" * 9, "b\nb"]
    for _ in range(60):
        part = prose(rng, rng.randint(1, 30))
        texts.append("\n".join(rng.choice([part, prose(rng, rng.randint(0, 20)), "a b", "***"]) for _ in range(rng.randint(1, 6))))
    m = quality_rules.measures([t.encode() for t in texts])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    assert [tuple(int(m[n][i]) for n in names) for i in range(len(texts))] == [brute_measures(t) for t in texts]


def test_rules_drop_repetition(spark):
    rng = random.Random(2)
    passage = prose(rng, 70)
    rows = [(1, prose(rng, 200)), (2, "too few"), (3, "again and again " * 50), (4, prose(rng, 1000) + " " + passage + " " + prose(rng, 5) + " " + passage)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False)}


def test_each_limit_rejects_by_itself(spark):
    """Rows that the base rule passes: the covered share alone drops one, the longest repeat alone another."""
    rng = random.Random(3)
    short, long_ = prose(rng, 12), prose(rng, 40)
    rows = [(1, f"{prose(rng, 100)} {short} {prose(rng, 30)} {short}"), (2, f"{prose(rng, 1000)} {long_} {prose(rng, 30)} {long_}"), (3, f"{prose(rng, 300)} {short} {prose(rng, 30)} {short}")]
    got = {r.doc_id: r for r in quality_rules.rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in (1, 2, 3)] == [False, False, True]
    assert got[1].covered_words > quality_rules.MAX_COVERED * got[1].n_words and got[1].longest_repeat <= quality_rules.MAX_REPEAT
    assert got[2].covered_words <= quality_rules.MAX_COVERED * got[2].n_words and got[2].longest_repeat > quality_rules.MAX_REPEAT


def labelled(n=900, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text, bad = prose(rng, rng.randint(20, 80), WORDS[lang]), rng.random() < 0.3
        if rng.random() < 0.3:
            text = " ".join(w + "###" for w in text.split())
        toxic = bad
        if toxic:
            w = text.split()
            w.insert(rng.randrange(len(w)), rng.choice(["scoundrel", "villain", "wretch"]) + rng.choice(["", "s"]))
            text = " ".join(w)
        rows.append((i, text, lang, "s", 0))
        labels.append((i, int("###" not in text), int(toxic)))
    return rows, labels


def test_language(spark):
    rows, _ = labelled()
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[r[0]].held_out == (fold(r[0], 3) == 1) for r in rows)
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows if fold(r[0], 3) == 1]) > 0.97


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows, _ = labelled(300)
    other = [(i, t, "xx" if fold(i, 3) == 1 else lang, s, n) for i, t, lang, s, n in rows]
    one, two = (sorted(map(tuple, language.identify(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, other))
    assert one == two


def test_quality(spark):
    rows, labels = labelled()
    got = {r.doc_id: r for r in quality_model.scored(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id int, quality int, toxic int")).collect()}
    out = [(got[i].predicted, q) for i, q, _ in labels if fold(i, 4) == 2]
    assert all(got[i].held_out == (fold(i, 4) == 2) for i, _, _ in labels)
    assert np.mean([a == b for a, b in out]) > 0.97


def test_toxicity(spark):
    rows, labels = labelled()
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id int, quality int, toxic int")).collect()}
    out = [(got[i].predicted, t) for i, _, t in labels if fold(i, 5) == 0]
    assert all(got[i].held_out == (fold(i, 5) == 0) for i, _, _ in labels)
    assert np.mean([a == b for a, b in out]) > 0.95


def test_every_place_of_three_texts_is_embedded():
    parts, n = len(toxicity.PARTS), 70_000
    texts = [np.arange(n, dtype=np.int32).reshape(-1, parts)] * 4
    m = toxicity.Model(texts, np.array([0.0, 1.0, 0.0, 1.0]), ["en"] * 4)
    assert len(np.unique(m.index[:n])) == n and m.index[:n].min() > 0 and len(m.e) == n + 1


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_model.Model(x[:3000], y[:3000])
    assert ((m.scores(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.9


def test_odd_rows(spark, odd, odd_rows, none, labels):
    empty = labels.limit(0)
    for f in (quality_rules.rules, language.identify, lambda d: quality_model.scored(d, labels), lambda d: toxicity.scored(d, labels), lambda d: quality_model.scored(d, empty), lambda d: toxicity.scored(d, empty)):
        assert f(odd).count() == len(odd_rows)
        assert f(none).count() == 0
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6))
    assert {r.score for r in quality_model.scored(odd, empty).collect()} == {0.5}
    assert {r.score for r in toxicity.scored(odd, empty).collect()} == {0.0}


ODD_TEXTS = ["", "a", "Is it?", "!!! ###", "x " * 40_000, "same words here", "same words here"]


def test_convolution_word_by_word():
    """Scores against loops over words, widths and filters; texts without words, equal ones and long ones."""
    rows, labels = labelled(300, 5)
    texts, words = toxicity.numbered([r[1].encode() for r in rows])
    m = toxicity.Model(texts, np.array([float(x[2]) for x in labels]), [r[2] for r in rows], words)
    some = [r[1] for r in rows[:20]] + ODD_TEXTS + ["only villain", "wretch"]
    at, n = toxicity.places([t.encode() for t in some])
    got = m.scores(np.split(at, np.cumsum(n)[:-1]))
    place = 0
    for text, size, score in zip(some, n.tolist(), got, strict=True):
        ids = m.index[at[place : place + size]]
        place += size
        e = [sum(m.e[i].astype(float) for i in word) for word in ids[:400]]
        gap = [np.zeros(toxicity.SIZE)] * 2
        pooled = []
        for w, k, b in zip(toxicity.WIDTHS, m.w, m.b, strict=True):
            best = [0.0] * toxicity.FILTERS
            for i in range(len(e)):
                window = (e + gap)[i : i + w]
                for f in range(toxicity.FILTERS):
                    best[f] = max(best[f], sum(float(x @ k[j][:, f]) for j, x in enumerate(window)) + float(b[f]))
            pooled += best
        spoken = max(range(len(m.names)), key=lambda c: (sum(float(m.spoken[i[0], c]) for i in ids), -c)) if size else 0  # noqa: B023
        logit = sum(p * float(v) for p, v in zip(pooled, m.v, strict=True)) + float(m.c) - m.cut[spoken]
        assert abs(score - 1 / (1 + np.exp(-np.clip(logit, -50, 50)))) < 1e-3, text[:40]
    assert len({round(float(x), 6) for x in got[25:27]}) == 1


def grams_of(text):
    """The hash places of a text's byte n-grams for each n."""
    b = bytearray()
    raw = text.encode()
    for i, x in enumerate(raw):
        if x >= 0x80:
            b.append(x + 0x20 if i and raw[i - 1] == 0xC3 and 0x80 <= x <= 0x9E else x)
        else:
            b.append(ord(chr(x).lower()) if chr(x).isalpha() else 0x20)
    b += b"   "
    out = [set(b)]
    for n, places in ((2, 4096), (3, 16384)):
        codes = {int.from_bytes(b[i : i + n], "little") for i in range(len(b) - n + 1)}
        out.append({(c * 0x9E3779B1 & 0xFFFFFFFF) >> (33 - places.bit_length()) for c in codes})
    return out


def test_kernel_ridge_by_sets():
    """The kernel as intersections of sets, the regression by least squares; no text depends on its neighbours."""
    rows, _ = labelled(120, 6)
    texts, langs = [r[1] for r in rows], [r[2] for r in rows]
    bits = np.packbits(language.presence([t.encode() for t in texts]).astype(bool), axis=1)
    m = language.Model(bits, langs)

    def kernel(a, b):
        return np.mean([len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(a, b, strict=True)])

    turn, order = Counter(), []
    for i, lang in enumerate(langs):
        order.append((turn[lang], i))
        turn[lang] += 1
    marks = [grams_of(texts[i]) for _, i in sorted(order)[: language.LANDMARKS]]
    values, vectors = np.linalg.eigh([[kernel(a, b) for b in marks] for a in marks])
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])
    f = np.array([[kernel(grams_of(t), b) for b in marks] for t in texts]) @ half
    target = np.array([[float(a == b) for b in m.langs] for a in langs])
    ridge = np.sqrt(language.RIDGE * len(f)) * np.eye(f.shape[1])
    w = np.linalg.lstsq(np.vstack([f, ridge]), np.vstack([target - target.mean(0), np.zeros((len(ridge), len(m.langs)))]), rcond=None)[0]
    some = [*ODD_TEXTS, "Été à l'école", *texts[:10]]
    want = np.array([[kernel(grams_of(t), b) for b in marks] for t in some]) @ half @ w + target.mean(0)
    got = m.scores([t.encode() for t in some])
    assert np.abs(got - want).max() < 5e-3
    assert np.abs(got - np.concatenate([m.scores([t.encode()]) for t in some])).max() < 1e-5


def test_additive_score_by_table():
    rows, labels = labelled(300, 7)
    texts = [r[1].encode() for r in rows]
    m = quality_model.Model(quality_model.features(texts), np.array([float(x[1]) for x in labels]))
    some = [t.encode() for t in ODD_TEXTS] + texts[:20]
    x = quality_model.features(some)
    assert np.allclose(x, np.concatenate([quality_model.features([t]) for t in some]))
    for row, score in zip(x, m.scores(x), strict=True):
        at = [bisect.bisect_right(c.tolist(), v) for c, v in zip(m.cuts, row, strict=True)]
        f = m.base + sum(t[i] for t, i in zip(m.tables, at, strict=True))
        for i, j, t in m.pairs:
            f += t[at[i] * quality_model.COARSE // len(m.tables[i]), at[j] * quality_model.COARSE // len(m.tables[j])]
        assert abs(score - 1 / (1 + np.exp(-f))) < 1e-9
    assert m.scores(x)[5] == m.scores(x)[6]


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A word of three toxic rows, wherever they stand among 8000 labelled ones, and every row's count; in several tasks."""
    rng = random.Random(9)
    rows = [(i, f"w{i} x{rng.randrange(50)} y{rng.randrange(50)}" + (" scoundrel" if i % 4 == 0 else ""), "en", "s", 0) for i in range(8000)]
    rare = [i for i in range(8000) if i % 4 == 0 and fold(i, 5) != 0]
    words = {i: f"unique{k // 6}q" for k, i in enumerate(rare)}
    rows = [(i, f"{t} {words.get(i, '')}", *rest) for i, t, *rest in rows]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(8000)], "doc_id int, toxic int")
    begun = []
    begin = toxicity.Model.begin
    monkeypatch.setattr(toxicity.Model, "begin", lambda self, *a: (begun.append(a), begin(self, *a)))
    monkeypatch.setattr(toxicity, "SHARD", 2000)
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    place, _, number, bad, toxic, texts = begun[0]
    n = sum(fold(i, 5) != 0 for i in range(8000))
    assert abs(texts - n * (1 - toxicity.CHECKED)) < 0.05 * n
    whole = {p: (int(a), int(b)) for p, a, b in zip(place.tolist(), number, bad, strict=True)}
    at = int(toxicity.places([b"scoundrel"])[0][0, 0])
    assert whole[at] == (toxic, toxic)
    known = sum(int(toxicity.places([w.encode()])[0][0, 0]) in whole for w in set(words.values()))
    assert known > 0.8 * len(set(words.values()))
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(8000) if fold(i, 5) == 0]) > 0.99
