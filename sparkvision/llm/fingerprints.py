"""Operator 6 [native]: threshold-scaled sketches.

A document's sketch is every hash of its five-word shingles below a fixed fraction of the hash range, the same for every
document, so the sketch of a union is the union of the sketches, and the share of a sketch found in another estimates
containment however unequal the two documents are. FRACTION is large because documents are short: it costs about eight
bytes for every other shingle, and a text of n different shingles has an empty sketch with probability 2**-n.

Only SQL functions are used. The next document of each is found without a global sort: ids are cut at their quantiles
into ranges, the first document of each range also goes to the range before (of the first, to the last), and each range
is ordered by itself.

Words are `[^\x20\x09-\x0D]+`; a text of one to four words has one shingle, all its words; null counts as empty, and an
empty or blank text has an empty sketch. Two texts with empty sketches are alike (1.0) if they hold
the same words or none, else not (0.0): chance may have left a sketch empty. An empty sketch is alike to no other one. A null id sorts first; rows with one id sort by text. Further columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import parts

SHINGLE = 5
FRACTION = 1 / 2
BLANK = " \t\n\x0b\x0c\r"
LEAST = -(1 << 63)


def threshold(fraction: float) -> int:
    """The greatest hash that every sketch keeps; hashes are signed."""
    return LEAST + int(fraction * (1 << 64)) - 1


def sketch(text: Column, fraction: float = FRACTION, k: int = SHINGLE) -> Column:
    """Sorted distinct hashes below the threshold."""
    words = F.split(F.btrim(text, F.lit(BLANK)), r"[\x20\x09-\x0D]+")
    limit = threshold(fraction)

    def hashes(w: Column) -> Column:
        # a lambda's argument is computed once; the words would else be split again for each shingle
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))
        return F.when(F.size(w) >= k, many).when(w[0] == "", F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(w)))

    return F.transform(F.transform(F.array(words), hashes), lambda h: scaled(h, limit))[0]


def scaled(h: Column, limit: int) -> Column:
    """Of an array of hashes those of the sketch."""
    return F.sort_array(F.array_distinct(F.filter(h, lambda x: x <= limit)))


def written_out(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def shared(a: Column, b: Column, equal: Column) -> Column:
    """(both, one, two, equal): how many hashes two sketches share, and have each; for two empty ones, whether their texts
    hold the same words."""
    return F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(a).alias("one"), F.size(b).alias("two"), equal.alias("equal"))


def words_if_empty(s: Column, text: Column) -> Column:
    """Of a text with an empty sketch, which is short, its words; else null."""
    return F.when(F.size(s) == 0, F.regexp_replace(F.btrim(text, F.lit(BLANK)), r"[\x20\x09-\x0D]+", " "))


def containment(c: Column) -> Column:
    """Of shared(): the share of the smaller document's shingles that the other has."""
    return F.when((c.one == 0) | (c.two == 0), F.when(c.equal, 1.0).otherwise(0.0)).otherwise(c.both / F.least(c.one, c.two))


def resemblance(c: Column) -> Column:
    """Of shared(): the Jaccard similarity."""
    return F.when((c.one == 0) | (c.two == 0), F.when(c.equal, 1.0).otherwise(0.0)).otherwise(c.both / (c.one + c.two - c.both))


def merged(sketches: Column, fraction: float = FRACTION) -> Column:
    """Aggregate: the sketch of the union of documents."""
    return F.transform(F.array(F.flatten(F.collect_list(sketches))), lambda h: scaled(h, threshold(fraction)))[0]


def with_next(docs: DataFrame, order: str, tie: str, carried: list[str], **derived: Column) -> DataFrame:
    """Adds the columns `derived` and next_<column> of the row that follows by (order, tie), the first after the last. `order`
    is a long, not null. Derived columns are computed where the row has arrived, so they are not sent."""
    spark = docs.sparkSession
    ranges = min(4 * parts(spark), 10_000)
    cut = docs.agg(F.min(order).alias("least"), F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cut")).first()
    if cut.least is None:
        return docs.withColumns(derived).select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    bounds = sorted({cut.least, *cut.cut})
    step = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse_at = F.from_json(F.lit(json.dumps([x[0] for x in fine])), "array<bigint>")
    fine_at = F.from_json(F.lit(json.dumps(fine)), "array<array<bigint>>")
    id_ = F.col(order)
    rows = docs.withColumn("_coarse", F.size(F.filter(coarse_at, lambda b: b <= id_)) - 1)
    own = F.element_at(fine_at, F.col("_coarse") + 1)
    rows = rows.withColumn("_fine", F.size(F.filter(own, lambda b: b <= id_)) - 1)
    rows = rows.withColumn("_first", F.element_at(own, F.col("_fine") + 1) == id_).withColumn("_range", F.col("_coarse") * step + F.col("_fine"))
    before = F.pmod(F.col("_range") - 1, F.lit(len(bounds)))
    copies = F.when(F.col("_first"), F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest")), F.struct(before.alias("at"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest"))))
    dealt = rows.withColumn("_to", F.explode(copies)).drop("_coarse", "_fine", "_first", "_range")
    dealt = dealt.select("*", F.col("_to.at").alias("_at"), F.col("_to.guest").alias("_guest")).drop("_to")
    dealt = dealt.repartition(parts(spark), "_at").withColumns(derived)
    w = Window.partitionBy("_at").orderBy("_guest", order, tie)
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).where(~F.col("_guest")).drop("_at", "_guest")


def fingerprints(docs: DataFrame, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (containment of the
    smaller in the other), jaccard_edited, jaccard_next. The edited text is the text with its last quarter replaced by
    as many code points from the start of the next document."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_next(own, "doc", "text", ["text", "own"], own=sketch(F.col("text"), fraction))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    own = own.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own", words_if_empty(F.col("own"), F.col("text")).alias("words"), words_if_empty(F.col("next_own"), F.col("next_text")).alias("next_words"))
    own = own.withColumn("changed", sketch(F.col("edited"), fraction))
    equal = lambda b: F.coalesce(F.col("words") == b, F.lit(False))
    own = own.withColumn("e", shared(F.col("own"), F.col("changed"), equal(words_if_empty(F.col("changed"), F.col("edited"))))).withColumn("x", shared(F.col("own"), F.col("next_own"), equal(F.col("next_words"))))
    e, x = F.col("e"), F.col("x")
    return own.select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written_out(F.col("own")).alias("fingerprint"), written_out(F.col("changed")).alias("edited_fingerprint"), containment(e).alias("near_edited"), containment(x).alias("near_next"), resemblance(e).alias("jaccard_edited"), resemblance(x).alias("jaccard_next"))
