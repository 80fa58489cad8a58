"""Long words, lines and passages that prefix sums modulo 2**64 cannot tell apart: patterns of Thue and Morse."""

import hashlib
import struct

import public_tokenizers
import pytest
import tokenizers

from sparkvision.llm import bpe, fingerprints, quality_rules, suffix_dedup, toxicity, window_dedup
from sparkvision.llm.text import Chunk

SCHEMA = "doc_id long, text string"


def pair(n, a="a", b="b"):
    """Two different texts of n symbols whose sums of symbol times power agree for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x == 0 else b for x in bits), "".join(b if x == 0 else a for x in bits)


def test_the_pattern_is_one():
    one, two = pair(2048)
    c = Chunk([one.encode(), two.encode()])
    h, n = c.prefix().tolist(), 2049
    assert (h[2048] - h[0]) % (1 << 64) == (h[n + 2048] - h[n]) * pow(0x9E3779B97F4A7C15, -n, 1 << 64) % (1 << 64)
    assert len(set(c.words().hash.tolist())) == 2


@pytest.mark.parametrize("n", [1024, 2048])
def test_tokens(n):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(path)
    texts = [f"{x} and {y}" for x, y in (pair(n), reversed(pair(n)))]
    ids, counts = own.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("n", [1024, 2048])
def test_windows_of_words(spark, n):
    rest = " ".join(f"w{i}" for i in range(19))
    rows = spark.createDataFrame([(1, f"{pair(n)[0]} {rest}"), (2, f"{pair(n)[1]} {rest}"), (3, f"{pair(n)[1]} {rest}")], SCHEMA)
    assert {r.doc_id: r.n_removed for r in window_dedup.remove_repeated_windows(rows).collect()} == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("n", [1024, 2048])
def test_lines_and_repeats(n):
    one, two = pair(n)
    got = quality_rules.measures([f"{one}\n{two}\n{one}".encode()])
    assert got["n_dup_lines"].tolist() == [1]
    # 2048 words in the pattern, then the other way round: the longest run of words that comes twice
    words = " ".join(pair(n, "x ", "y ")).split()
    got = quality_rules.measures([" ".join(words).encode()])
    longest = max(k for k in range(1, 2 * n) if len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)}) < len(words) - k + 1) if n == 1024 else None
    assert longest is None or got["longest_repeat"].tolist() == [longest]


def test_bytes(spark):
    """No string of 400 bytes is shared: every 256 bytes the two differ in one byte, in the pattern's order."""
    spacer = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(4))[:255]
    one, two = ("".join(x + spacer for x in p) for p in pair(2048))
    rows = [(1, one), (2, two)]
    assert [tuple(r)[1:4] for r in suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA)).collect()] == [tuple(brute(t, rows)) for _, t in rows]
    texts = ["".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(64)) for k in range(2)]
    clean = [(i, "".join(x if j % 256 else p[j // 256] for j, x in enumerate(texts[0] * 1))) for i, p in enumerate(pair(2048))]
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame([*clean, (9, texts[1])], SCHEMA), window=1200).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: brute(t, clean, 1200)[1] for i, t in [*clean, (9, texts[1])]}


def brute(text, rows, window=400):
    every = [t[i : i + window] for _, t in rows for i in range(len(t) - window + 1)]
    often = {w for w, n in __import__("collections").Counter(every).items() if n > 1}
    gone = [False] * len(text)
    for i in range(len(text) - window + 1):
        if text[i : i + window] in often:
            gone[i : i + window] = [True] * window
    return len(text), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def test_short_texts_are_not_alike_by_chance(spark):
    rows = [(i, f"word{i}") for i in range(200)] + [(300, "same words"), (301, " same  words\n"), (302, ""), (303, " \t")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i].fingerprint == "" for i in range(200)) > 50
    assert {got[i].near_next for i in range(199)} == {0.0} and {got[i].jaccard_next for i in range(199)} == {0.0}
    assert got[300].near_next == 1.0 and got[301].near_next == 0.0 and got[302].near_next == got[302].near_edited == 1.0


def test_a_text_beyond_the_bound_leaves_the_others(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(i, f"this is {'awful hateful' if i % 2 else 'a nice good'} text number {i} " * 3, "en") for i in range(1, 201)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(-300, 201)], "doc_id long, toxic int")
    usual = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(rows, schema), labels, sample_bytes=50_000).collect()}
    assert len(set(usual.values())) > 1
    long_ = [(i, " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(400)), "en") for i in range(-300, -200)]
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame([*rows, *long_], schema), labels, sample_bytes=50_000).collect()}
    assert {i: got[i] for i in usual} == pytest.approx(usual, abs=1e-6)


def test_ids_are_as_the_library_gives_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    one, two = pair(1024, "é", "ü")
    own, library = bpe.Vocabulary(path), tokenizers.Tokenizer.from_file(path)
    for t in (one, two):
        ids = own.encode([t])[0].tolist()
        assert struct.pack(f"<{len(ids)}I", *ids) == struct.pack(f"<{len(ids)}I", *library.encode(t, add_special_tokens=False).ids)
