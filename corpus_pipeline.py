"""From raw documents to packed training sequences, in stages of which each is an operator of sparkvision.llm.

Every stage but the last returns the columns of `documents` and works on all that its predecessor kept. Null and empty
texts go in the first stage, as they have no language. Equal rows are copies of each other, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvision.llm import language, ngram_join, packing, quality_model, suffix_dedup
from sparkvision.llm.queries import WORD_BPE, table
from sparkvision.llm.scratch import dropped, freed, kept, written
from sparkvision.sources.package import shipped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below these a document is rejected.
LEAST_KNOWN_SHARE, LEAST_QUALITY = 0.5, 0.5
#: Bytes of a string that is cut out where it repeats. Passages of over 50 words are meant: 51 words of four letters have 255.
#: A window of 400 bytes, as operator 10's query has, misses those of up to 65 usual words.
PASSAGE = 256


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or hardly like any that was learned, go."""
    shipped(spark)
    told = language.identify(docs, keep=COLUMNS, spelling=True)
    return told.where((F.col("lang_pred") != "und") & (F.col("known_share") >= LEAST_KNOWN_SHARE)).select(COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely bad than good go."""
    shipped(spark)
    scored = quality_model.scored(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays, of several with that id the text with the least
    hash; ids that are null or stand on other texts as well make no difference."""
    shipped(spark)
    # columns that are never null stand for id and text: the join then deals texts out as dropDuplicates needs them, once
    key = {"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull(), "_mark": F.xxhash64("text")}
    first = ngram_join.representatives(docs).select(F.coalesce("doc", F.lit(0)).cast(docs.schema["doc_id"].dataType).alias("_id"), F.col("doc").isNull().alias("_none"), F.col("mark").alias("_mark"))
    return docs.withColumns(key).join(first, [*key], "left_semi").dropDuplicates([*key]).select(COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that occur more than once are cut out of the texts."""
    shipped(spark)
    cut = suffix_dedup.remove_repeated_bytes(docs, PASSAGE, with_text=True, keep=["lang", "source"])
    n = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", n.alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return packing.pack(docs.select(COLUMNS), WORD_BPE)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Learned models and suffix arrays cannot be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = kept()
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
        freed(before, docs)  # what the stage itself kept, and what it has read
        if i:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
