"""Operators 8 and 9 against the tokenizers library and a plain packing."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tokenizers

from sparkvision.llm import bpe, packing


PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def u32(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_random_texts(library):
    rng = random.Random(1)
    letters = "abcxyzéß'’́ ,.!?1२ΣςДжİ中ﬁ \n\t🙂<|>" + "\x00\x1c​ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "it's we'LL ''s 'street !'s I'D", "a" * 500, "ab" * 300, "", " "]
    own = bpe.Vocabulary(PATH)
    ids, counts = own.encode(texts)
    at = 0
    for text, n, e in zip(texts, counts.tolist(), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == e.ids, text
        assert own.decoded(ids[at : at + n]).decode() == library.decode(e.ids, skip_special_tokens=False)
        at += n


def test_cuts_are_forced():
    own = bpe.Vocabulary(PATH)
    a, b = next((a, b) for a in range(97, 123) for b in range(97, 123) if not own.joined[a, b])
    assert not any(bytes([a, b]) in t for t in own.token_bytes)


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    own = bpe.Vocabulary(PATH)
    for k in range(5):
        text = " ".join(f"word{k}x{i}" for i in range(60))
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) < 500


def test_encode_decode(spark, odd, odd_rows, none, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(odd, PATH).collect())
    want = []
    for r in odd_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want) and bpe.encode_decode(none, PATH).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, odd, odd_rows, library, capacity):
    rows = packing.pack(odd, PATH, capacity).collect()
    want = defaultdict(int)
    for r in odd_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[r[0], k // capacity, k, len(part), zlib.crc32(u32(part))] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.01 * total / capacity + 1


def test_no_documents(none):
    assert packing.pack(none, PATH).count() == 0


def test_fullest_is_best():
    rng = random.Random(3)
    for _ in range(200):
        available = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(1, 90)
        sums = {0}
        for k, n in available.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        take = packing.fullest(available, room)
        assert all(take[k] <= available[k] for k in take)
        assert sum(k * n for k, n in take.items()) == max(s for s in sums if s <= room)
