"""Frontiers of cost and accuracy from hulls of parts.

A point that another one beats, or that lies clearly under a chord between two others, can be left out whatever else there
is. So each task thins the points that it reads to a hull for each group, hulls of hulls are thinned again, and only what is
left of a group, a few dozen points for most data, is walked by the exact rule. All steps are linear after a sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cross products below this share of their terms don't rule a point out before the last walk.
CLEAR = 1e-6
#: Points that a task holds before it thins them.
HELD = 1 << 18
#: Tasks among which the hulls of one group are dealt out before they meet.
SALTS = 32


def thinned(cost: np.ndarray, acc: np.ndarray, slack: float) -> np.ndarray:
    """The places, by cost, of points that may be on the frontier: no cheaper one is as good, and none lies under a chord by
    more than rounding and slack could make of it."""
    order = np.lexsort((-acc, cost))
    before = np.maximum.accumulate(np.append(-np.inf, acc[order]))[:-1]
    order = order[acc[order] > before]
    chain: list[int] = []
    x, y = cost[order].tolist(), acc[order].tolist()
    for i in range(len(x)):
        while len(chain) > 1:
            a, q = chain[-2], chain[-1]
            to, on = (y[q] - y[a]) * (x[i] - x[q]), (y[i] - y[q]) * (x[q] - x[a])
            if not on - to > 2 * slack + CLEAR * (abs(on) + abs(to)):
                break
            chain.pop()
        chain.append(i)
    return order[chain]


def walked(cost: list[float], acc: list[float], slack: float) -> list[int]:
    """The exact rule on points sorted by cost, then from the best accuracy: better than all cheaper ones by more than the
    slack, and then under no chord: a point goes as soon as the next one leaves it with a smaller slope before than behind."""
    chain: list[int] = []
    best = -float("inf")
    for i in range(len(cost)):
        if not acc[i] > best + slack:
            continue
        best = acc[i]
        while len(chain) > 1:
            a, q = chain[-2], chain[-1]
            if not (acc[q] - acc[a]) * (cost[i] - cost[q]) + slack < (acc[i] - acc[q]) * (cost[q] - cost[a]):
                break
            chain.pop()
        chain.append(i)
    return chain


def frontier(points: DataFrame, group: str, slack: float) -> DataFrame:
    """(group, cost, acc, point_id) of the points on each group's frontier; of equal points the least point_id."""
    own = points.select(group, F.col("cost").cast("double").alias("cost"), F.col("acc").cast("double").alias("acc"), "point_id", (F.spark_partition_id() % SALTS).alias("_salt"))
    own = own.where("cost IS NOT NULL AND acc IS NOT NULL AND NOT isnan(cost) AND NOT isnan(acc)")
    schema = own.schema

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, HELD
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > limit:
                held = [least(held)]
                size = held[0].num_rows
                if size > limit // 2:  # that many groups, or so many points on hulls: they go on
                    yield from held
                    held, size = [], 0
        if held:
            yield least(held)

    def least(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        df = pa.Table.from_batches(batches).to_pandas().sort_values("point_id", kind="stable")
        keep = [g.iloc[thinned(g.cost.to_numpy(), g.acc.to_numpy(), slack)] for _, g in df.groupby(group, dropna=False, sort=False)]
        out = pd.concat(keep) if keep else df
        return pa.RecordBatch.from_pandas(out, schema=batches[0].schema, preserve_index=False)

    def last(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["cost", "acc", "point_id"], ascending=[True, False, True], kind="stable")
        return df.iloc[walked(df.cost.tolist(), df.acc.tolist(), slack)]

    spread = own.mapInArrow(thin, schema).repartition(group, "_salt").mapInArrow(thin, schema)
    return spread.groupBy(group).applyInPandas(last, schema).drop("_salt")
