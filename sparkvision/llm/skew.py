"""Joins of rows with facts about their key, of which one key may have a third of all rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than 1/HOT of all rows, so there are fewer than HOT of them; and LEAST rows at least.
HOT, LEAST = 1000, 1000


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame | None:
    """(key, _salts) of the hot keys, with the parts that each is to be dealt out to; None if there are none. counts has one
    row a key with its number of rows, and is read twice."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(LEAST, total // HOT)
    if total <= limit:
        return None
    found = counts.where(F.col(n) > limit).select(key, F.ceil(F.col(n) / F.lit(limit)).cast("int").alias("_salts")).toArrow()
    return counts.sparkSession.createDataFrame(found) if found.num_rows else None


def counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("_rows"))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str | None, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows with the facts of their key, of which there is one row. The rows of a hot key are dealt out by `by` (None: by
    their place), as finely as they are many, and its facts are repeated for each part."""
    if hot is None:
        return rows.join(facts, key, how)
    few = F.broadcast(hot)  # fewer than HOT rows
    spread = F.xxhash64(by if by else F.monotonically_increasing_id())
    left = rows.join(few, key, "left").withColumn("_salt", F.pmod(spread, F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = facts.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
