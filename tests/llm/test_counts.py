"""Operator 13 against the libraries on whole texts."""

import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from sparkvision.llm import token_counts

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    if path.endswith(".model"):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(own.encode(t))
    own = tokenizers.Tokenizer.from_file(path)
    return lambda t: len(own.encode(t, add_special_tokens=False))


def texts():
    rng = random.Random(4)
    letters = list("abcxyzé'’́ ,.!?1२ΣςДжİ中ﬁ \n\t\r🙂<|>_▁") + ["\x00", "\x1c", "\x1f", "\x85", "\xa0", "　", "​", " ", "  ", "\n\n", "'s", "'ll ", "<|endoftext|>", "</s>"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    words = ["word", "it's", "x1", "the", "  two", "\n", "中文", "a.b", "<|endoftext|>", " "]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    return [*out, "", " ", "\n", "a" * 5000, "中" * 3000, " " * 500, "a b " * 30_000, "<|endoftext|>" * 3, "x <|endoftext|> y", " <|endoftext|>", "<|endoftext| >"]


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_as_the_library(path, monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH", 3000)
    monkeypatch.setattr(token_counts, "MEMORY", 500)
    own, want = token_counts.Counter(path), library(path)
    every = texts()
    for i in range(0, len(every), 100):
        some = every[i : i + 100]
        assert own.counts(some) == [want(t) for t in some]
        assert all(len(p) <= token_counts.SHORT for p in own.known)


def test_boundaries_are_used():
    assert token_counts.Counter(BYTES).safe("it's  so\n\nx ") == ["it's", "  so", "\n\nx", " "]
    assert token_counts.Counter(PIECES).safe("a b  c d.") == ["a", "b  c", "d."]
    assert token_counts.Counter(WORDS).safe is None


def test_batches_are_balanced():
    pieces = ["x" * n for n in (5, 900, 40, 3000, 10, 10)]
    got = list(token_counts.balanced(pieces, 1000))
    assert [p for b in got for p in b] == pieces and all(len(b) == 1 or sum(map(len, b)) <= 1000 for b in got)


def test_counts(spark, odd, odd_rows, none):
    want = library(BYTES)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, BYTES).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), want(r[1] or ""), want(r[1] or "") > 1024) for r in odd_rows)
    assert token_counts.token_counts(none, BYTES).count() == 0
    some = token_counts.token_counts(odd, BYTES, limit=3).where("doc_id = 7").collect()
    assert [r.over_limit for r in some] == [r.n_tokens > 3 for r in some]


def test_whole_table(spark, sf_dir):
    from sparkvision.llm import queries

    want = library(BYTES)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, sf_dir).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), want(r.text or ""), want(r.text or "") > 1024) for r in rows}
