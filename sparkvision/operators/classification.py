"""Class scores and depth maps, in long form (one row per element of a tensor)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(logits: DataFrame, group: str = "image_id", x: str = "x") -> DataFrame:
    """Adds prob: exp(x - max) over its sum in the group."""
    w = Window.partitionBy(group)
    own = logits.withColumn("_e", F.exp(F.col(x) - F.max(x).over(w)))
    return own.withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def softmax_array(values: Column) -> Column:
    """The same for an array column, without a shuffle."""
    shifted = F.transform(values, lambda v: F.exp(v.cast("double") - F.array_max(values).cast("double")))
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def top_k(probs: DataFrame, k: int = 5, group: str = "image_id", index: str = "class_idx", value: str = "prob") -> DataFrame:
    """The k greatest, of equal ones that with the greater index, with their rank from 1."""
    w = Window.partitionBy(group).orderBy(F.desc(value), F.desc(index))
    return probs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def depth_normalised(pixels: DataFrame, group: str = "image_id", value: str = "x") -> DataFrame:
    """Adds depth: (value - least) / (greatest - least + 1e-8) in the group."""
    w = Window.partitionBy(group)
    low = F.min(value).over(w)
    return pixels.withColumn("depth", (F.col(value) - low) / (F.max(value).over(w) - low + 1e-8))


def first_output(outputs: Column) -> Column:
    """Of an array of outputs the first, which holds the depth map or the class scores."""
    return F.try_element_at(outputs, F.lit(1))
