"""Bounded samples of labelled rows, chosen by a hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Is the row outside what may be learned from? A row without an id is."""
    return F.coalesce(remainder(id_col, folds) == fold, F.lit(True))


def labelled_ids(labels: DataFrame, label: str, id_col: str, folds: int, fold: int) -> DataFrame:
    """(sample_id, label) of all labelled ids outside the held-out fold. An id with several labels has their greatest."""
    own = labels.select(F.col(id_col).alias("sample_id"), F.col(label).cast("int").alias("label")).where("sample_id IS NOT NULL AND label IS NOT NULL")
    return own.where(~held_out("sample_id", folds, fold)).groupBy("sample_id").agg(F.max("label").alias("label"))


def label_sample(labels: DataFrame, label: str, id_col: str, folds: int, fold: int, limit: int) -> DataFrame:
    """At most `limit` of the labelled ids, the same ones each time."""
    return labelled_ids(labels, label, id_col, folds, fold).orderBy(F.xxhash64("sample_id"), "sample_id").limit(limit)


def in_order(id_col: str, *content: str) -> list[Column]:
    """Columns `_h`, `_m` that order sampled rows by what they hold, not by the task that they come from."""
    return [F.xxhash64(id_col).alias("_h"), F.xxhash64(*content).alias("_m")]


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows in that order: ids of a sample may stand on several rows."""
    return rows.orderBy("_h", "_m").limit(limit)
