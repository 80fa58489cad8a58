"""Benchmark results: frontiers, speed-ups, scaling, work still to do, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hulls import frontier

SLACK = 1e-9


def pareto(points: DataFrame, group: str = "family") -> DataFrame:
    """Adds frontier: of each group's points, by cost then from the best accuracy, those better than all cheaper ones and not
    under a chord between two others on the frontier. points: group, point_id, cost, acc. Points without cost or accuracy
    are on no frontier."""
    kept = frontier(points, group, SLACK).select(group, "point_id", F.lit(True).alias("frontier"))
    return points.join(kept, [group, "point_id"], "left").withColumn("frontier", F.coalesce("frontier", F.lit(False)))


def first_prefix(name: Column, prefixes: list[str]) -> Column:
    """The first of the prefixes that the name starts with, else unknown."""
    return F.coalesce(*[F.when(name.startswith(p), F.lit(p)) for p in prefixes], F.lit("unknown"))


def remaining(work: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Work without a stored result."""
    return work if overwrite else work.join(done.select(*keys).distinct(), keys, "left_anti")


def stored(old: DataFrame, new: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """A keyed store after writing new rows: they replace old ones with their keys, or, without overwrite, give way."""
    if overwrite:
        return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def ranked(results: DataFrame, group: str, mean: str = "mean") -> DataFrame:
    """Adds rank by mean, and best_speedup: slowest over fastest of the group."""
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(mean, "config"))
    return results.withColumn("rank", rank).withColumn("best_speedup", F.max(mean).over(w) / F.min(mean).over(w))


def speedups(configs: DataFrame, results: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """Per group and config: baseline / mean, 0.0 where either is missing. results may hold mean or mean_ms."""
    mean = F.coalesce("mean", "mean_ms")
    own = configs.join(results.select(*keys, mean.alias("_mean")), keys, "left")
    group = [k for k in keys if k != "config"]
    base = F.max(F.when(F.col("config") == baseline, F.col("_mean"))).over(Window.partitionBy(*group))
    return own.withColumn("speedup", F.coalesce(F.when(F.col("_mean") > 0, base / F.col("_mean")), F.lit(0.0))).drop("_mean")


def scaling_efficiency(results: DataFrame, model: str = "model") -> DataFrame:
    """Adds efficiency: tp(b) / (b * tp(1)); models without a positive throughput at batch 1 go."""
    one = F.max(F.when(F.col("batch_size") == 1, F.col("throughput"))).over(Window.partitionBy(model))
    own = results.withColumn("_one", one).where("_one > 0")
    return own.withColumn("efficiency", F.col("throughput") / (F.col("batch_size") * F.col("_one"))).drop("_one")


def whole_mean(x: str) -> Column:
    """Aggregate: the mean of counts, cut to a whole number."""
    return (F.sum(x) / F.count(x)).cast("long")


def device_group(name: Column) -> Column:
    return F.when(name.contains("Xavier") | name.contains("Orin"), "jetson").otherwise("rtx")


def report_rows(results: DataFrame, frameworks: list[str]) -> DataFrame:
    """One text row for each device, framework (in reverse order), model and size: comma separated, N/A for what is missing."""
    order = F.array_position(F.array(*map(F.lit, frameworks)), F.col("framework"))
    cells = [F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.1f", F.col(c).cast("double"))) for c in ("mean", "median", "min", "max")]
    own = results.withColumn("place", F.lit(len(frameworks)) - order)
    return own.select("device", "place", F.concat_ws(",", "framework", "model", F.col("size").cast("string"), *cells).alias("row"))
