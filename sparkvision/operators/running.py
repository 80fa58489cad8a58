"""Running sums and places over a whole table in one order, without one task that sees it all.

The order's values are cut at approximate quantiles into ranges; sums run inside each range, and the totals of the ranges
before it, of which there are at most RANGES, are added. The cuts decide how the work is dealt out, never the result.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024


def cuts_of(rows: DataFrame, order: str) -> list[float]:
    """Ascending different values that cut the rows into ranges of about equal size."""
    n = min(RANGES, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n)).first()[0]
    return sorted(set(found or []))


def range_of(rows: DataFrame, order: str, cuts: list[float], name: str) -> DataFrame:
    """Adds `name`: how many finite cuts are at most the value, by binary search."""
    inner = [c for c in cuts if math.isfinite(c)]
    if not inner:
        return rows.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=order, outputCol=name, handleInvalid="keep").transform(rows)


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, str], cuts: list[float]) -> DataFrame:
    """Adds the columns named in `sums`: the sum of a column over all rows up to this one by `order`, whose first column the
    cuts are of. Rows that are equal in all of `order` count in any order, so they should differ."""
    own = range_of(rows, order[0], cuts, "_range")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = own.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{name}") for name, c in sums.items()])
    # a row a range; of RANGES at most
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *[F.coalesce(F.sum(f"_all_{name}").over(ranges), F.lit(0)).alias(f"_before_{name}") for name in sums])
    own = own.withColumns({name: F.sum(c).over(within) for name, c in sums.items()}).join(F.broadcast(before), "_range")
    return own.withColumns({name: F.coalesce(F.col(name), F.lit(0)) + F.col(f"_before_{name}") for name in sums}).drop("_range", *[f"_before_{name}" for name in sums])
