"""Operator 2: quality rules with suffix-array repetition.

The words of many documents form one array in which no suffix reaches past its document. Suffixes are sorted by
Larsson-Sadakane refinement until every group of equal ones is settled; Kasai's rule gives the common prefixes of
neighbours. The deepest interval of common prefixes around a suffix is the longest repeat that starts there, so the
repeats of at least MIN_REPEAT words, laid over each other, cover all maximal repeated substrings. A document is dropped
if they cover more than MAX_COVERED of its words or if the longest has more than MAX_REPEAT words. Both are tighter than
the base rule below, so that they decide: words in repeats of 8 lie in repeats of 5 as well.

Base rules: fewer than 10 words, or over 20 % of the words in five-word windows that occur twice, fail.

Null, empty and blank texts have no words and fail. Rows are judged one by one, so repeated rows and ids, null ids and
further columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .superwindows import word_powers
from .text import U, Chunk, chunks, content_hash, mix

MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.1, 32
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def suffix_order(word: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the suffixes sorted by document, then by their words, in the order of their hashes; of each refinement the ranks,
    which are equal for two places of a document if and only if the next 1, 2, 4, ... words are)."""
    n = len(word)
    sa = np.argsort(word, kind="stable")
    sa = sa[np.argsort(doc[sa], kind="stable")]
    edge = np.append(True, (word[sa][1:] != word[sa][:-1]) | (doc[sa][1:] != doc[sa][:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    rank[sa] = np.maximum.accumulate(np.where(edge, np.arange(n), 0)) + 1
    slots = np.flatnonzero(~edge | ~np.append(edge[1:], True))
    h, levels = 1, [rank.astype(np.int32)]
    while len(slots):
        at = sa[slots]
        next_ = np.where(at + h < end[at], rank[np.minimum(at + h, n)], 0)
        key = rank[at].astype(U) << U(32) | next_.astype(U)
        order = np.argsort(key)
        key, at = key[order], at[order]
        sa[slots] = at
        edge = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(edge, slots, 0)) + 1
        slots = slots[~edge | ~np.append(edge[1:], True)]
        h *= 2
        levels.append(rank.astype(np.int32))
    return sa, levels


def longest_repeats(c: Chunk) -> np.ndarray:
    """Of each word's place: the words of the longest repeat that starts there."""
    n = len(c.hash)
    if not n:
        return np.zeros(0, np.int64)
    end = np.repeat(c.first[1:], c.counts)
    sa, levels = suffix_order(c.hash, c.doc, end)
    before = np.full(n, -1)
    before[sa[1:]] = np.where(c.doc[sa[1:]] == c.doc[sa[:-1]], sa[:-1], -1)
    i = np.arange(1, n)
    b = np.maximum(before[:-1], 0)
    follows = np.zeros(n, bool)
    follows[1:] = (before[:-1] >= 0) & (before[1:] == b + 1) & (c.hash[i - 1] == c.hash[b]) & (c.doc[i] == c.doc[i - 1])
    a = np.flatnonzero(~follows & (before >= 0))
    b, prefix = before[a], np.zeros(n, np.int64)
    most, length = end[a] - np.maximum(a, b), np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        fits = np.flatnonzero(length + (1 << k) <= most)
        same = levels[k][a[fits] + length[fits]] == levels[k][b[fits] + length[fits]]
        length[fits[same]] += 1 << k
    prefix[a] = length
    anchor = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    prefix = np.where(follows, prefix[anchor] - (np.arange(n) - anchor), prefix)
    ordered = prefix[sa]
    out = np.empty(n, np.int64)
    out[sa] = np.maximum(ordered, np.append(ordered[1:], 0))
    return out


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """By place: is it inside any start:start+length?"""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change)[:n] > 0


def by_doc(marks: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc[marks], minlength=n)


def twice(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each (doc, key): 0 if it is alone, 1 for the first of several, 2 for the later ones."""
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1]) if len(key) else np.zeros(0, bool)
    out = np.zeros(len(key), np.int64)
    if len(key):
        out[order] = np.where(np.append(False, same), 2, np.append(same, False))
    return out


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text."""
    c = Chunk(texts).words()
    n = c.n
    points = np.append(0, np.cumsum(c.buf & 0xC0 != 0x80))
    # lines: from each text's start or the byte after a line feed to the next line feed or the text's end
    feed = np.flatnonzero(c.buf == 0x0A)
    start = np.sort(np.concatenate([c.begin, feed + 1]))
    stop = np.sort(np.concatenate([c.end, feed]))
    line = content_hash(c.buf, start, stop)
    line_doc = np.searchsorted(c.begin, start, side="right") - 1
    with_word = np.searchsorted(c.start, stop) > np.searchsorted(c.start, start)
    line, line_doc = line[with_word], line_doc[with_word]
    # windows of five words
    up, wdown = word_powers(len(c.hash) + 1)
    sums = np.zeros(len(c.hash) + 1, U)
    np.cumsum(c.hash * up[: len(c.hash)], out=sums[1:])
    at = np.flatnonzero(c.doc[: max(0, len(c.doc) - WINDOW + 1)] == c.doc[WINDOW - 1 :]) if len(c.doc) >= WINDOW else np.zeros(0, np.int64)
    again = at[twice(mix((sums[at + WINDOW] - sums[at]) * wdown[at]), c.doc[at]) > 0]
    repeats = longest_repeats(c)
    long_ = np.flatnonzero(repeats >= MIN_REPEAT)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, c.doc, repeats)
    return {
        "n_words": c.counts,
        "word_chars": np.bincount(c.doc, points[c.stop] - points[c.start], n).astype(np.int64),
        "n_symbols": np.append(0, np.cumsum(SYMBOL[c.buf]))[c.end] - np.append(0, np.cumsum(SYMBOL[c.buf]))[c.begin],
        "n_dup_lines": by_doc(twice(line, line_doc) == 2, line_doc, n),
        "n_repeat_words": by_doc(covered(again, np.full(len(again), WINDOW), len(c.hash)), c.doc, n),
        "covered_words": by_doc(covered(long_, repeats[long_], len(c.hash)), c.doc, n),
        "longest_repeat": longest,
    }


def rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, the counts, base_failed, kept, covered_words (in repeats of at least MIN_REPEAT words) and
    longest_repeat (words)."""
    kept = docs.select(id_col, text_col)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([kept.schema[0], *[T.StructField(x, T.LongType()) for x in longs], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("covered_words", T.LongType()), T.StructField("longest_repeat", T.LongType())])

    def run(batches):
        for rows, texts in chunks(batches, text_col):
            m = measures(texts)
            failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
            good = ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(m[x], pa.int64()) for x in longs), pa.array(failed), pa.array(good), pa.array(m["covered_words"], pa.int64()), pa.array(m["longest_repeat"], pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)


#: The same rows in SQL: a repeat of at least m words is a run of m-word windows that occur twice.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
sized AS (SELECT doc_id, text, words, len(words) AS n FROM w),
windows AS (
  SELECT doc_id, k, i, list_aggregate(words[i : i + k - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, words, n, unnest([5, 8, 33]) AS k FROM sized) AS s, LATERAL (SELECT unnest(range(1, n - k + 2)) AS i)
),
marked AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, win) AS c FROM windows) WHERE c > 1),
cover AS (SELECT k, doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM marked) GROUP BY k, doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, s.n AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(c8.n, 0) AS covered_words, c33.n IS NOT NULL AS too_long
  FROM sized s LEFT JOIN dup ON dup.doc_id = s.doc_id
  LEFT JOIN cover r ON r.doc_id = s.doc_id AND r.k = 5 LEFT JOIN cover c8 ON c8.doc_id = s.doc_id AND c8.k = 8
  LEFT JOIN cover c33 ON c33.doc_id = s.doc_id AND c33.k = 33
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND covered_words <= 0.1 * n_words AND NOT too_long AS kept,
  CAST(covered_words AS BIGINT) AS covered_words
FROM counts
"""
