"""Operator 13: token counts by batch encoding, without keeping a single id.

Texts are cut at safe boundaries, where no token can lie on both sides: in byte-level vocabularies before each run of white
space that follows another sign, because every rule of their pre-tokeniser ends there; in sentence-piece vocabularies in
which no piece has a word start inside, at each single space between two ASCII letters or digits. A long text so becomes
short pieces, and the library encodes each different piece once, in batches of BATCH bytes; only their lengths are kept, and
a text's count is the sum over its pieces. A worker remembers the lengths of at most MEMORY pieces of at most SHORT
characters. A piece with no safe boundary inside is encoded whole, and so is every text under a vocabulary for which the
above doesn't hold (`Counter.safe` is None).

Null text counts as empty: no bytes, no tokens. Rows are counted one by one, so repeated rows and ids, null ids and further
columns of any name change nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import chunks

LIMIT = 1024
#: Bytes of texts or pieces that the library gets at once.
BATCH = 1 << 20
MEMORY, SHORT = 1_000_000, 40
#: White space with the signs that follow it. Python's white space holds all that the libraries' rules know.
AFTER_SIGNS = re.compile(r"\s*\S+|\s+")
#: A single space between ASCII letters or digits; it stands for the start of the next piece and goes.
BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def balanced(pieces: Iterable[str], limit: int = BATCH) -> Iterator[list[str]]:
    """Batches of about `limit` characters; a longer piece is a batch of its own."""
    batch, size = [], 0
    for piece in pieces:
        if batch and size + len(piece) > limit:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += len(piece) + 16
    if batch:
        yield batch


class Counter:
    """The number of tokens of texts: by `tokenizers` for a .json file, by `sentencepiece` for a .model file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = self.of_pieces = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            inside = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            whole = model.encode("a b") == [*model.encode("a"), *model.encode("b")]  # a word start is put before each text
            self.safe = None if inside or not whole else BETWEEN_WORDS.split
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.lengths = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            rule = spec.get("pre_tokenizer") or {}
            byte_level = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
            plain = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
            self.safe = AFTER_SIGNS.findall if byte_level and plain and not spec.get("normalizer") and not spec.get("post_processor") else None

            def pieces(texts: list[str]) -> list[int]:
                # pieces as the words of one input, which is cheaper than an encoding for each
                word = model.encode(texts, is_pretokenized=True, add_special_tokens=False).word_ids
                return np.bincount(np.array(word, np.int64), minlength=len(texts)).tolist()

            self.of_pieces = pieces

    def counts(self, texts: list[str]) -> list[int]:
        if self.safe is None:
            return [n for batch in balanced(texts) for n in self.lengths(batch)]
        cut = [self.safe(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = set().union(*cut) - self.known.keys()
        long_ = {p for p in new if len(p) > SHORT}
        for batch in balanced(sorted(new, key=len)):
            self.known.update(zip(batch, self.of_pieces(batch), strict=True))
        out = [sum(map(self.known.__getitem__, pieces)) for pieces in cut]
        for piece in long_:
            del self.known[piece]
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens). `path` must name the vocabulary on
    every executor."""
    kept = docs.select(id_col, text_col)
    schema = T.StructType([kept.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        own = counter(path)
        for rows, texts in chunks(batches, text_col, BATCH):
            n = own.counts([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return kept.mapInArrow(run, schema)
