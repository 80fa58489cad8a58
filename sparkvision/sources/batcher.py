"""A user's batches as a data source: Spark asks for them by number, in as many tasks as there are partitions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "batch_id long, shape array<int>, data array<float>"


class Numbers(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class Reader(DataSourceReader):
    def __init__(self, n_batches: int, shape: tuple[int, ...], batch: Callable[[int], Sequence[float]], partitions: int):
        self.n_batches, self.shape, self.batch, self.n_partitions = n_batches, shape, batch, partitions

    def partitions(self) -> Sequence[InputPartition]:
        step = max(1, math.ceil(self.n_batches / self.n_partitions))
        return [Numbers(i, min(i + step, self.n_batches)) for i in range(0, self.n_batches, step)] or [Numbers(0, 0)]

    def read(self, partition: Numbers) -> Iterator[tuple]:
        size = math.prod(self.shape)
        for i in range(partition.first, partition.end):
            data = [float(x) for x in self.batch(i)]
            if len(data) != size:
                raise ValueError(f"batch {i} has {len(data)} values, not {size}")
            yield i, list(self.shape), data


def read(spark: SparkSession, n_batches: int, shape: tuple[int, ...], batch: Callable[[int], Sequence[float]], partitions: int | None = None) -> DataFrame:
    """(batch_id, shape, data) of the batches 0 to n_batches - 1; `batch(i)` gives the values of one and may be asked for it
    more than once. The function travels with the source, so it must not hold what cannot be pickled."""
    reader = Reader(n_batches, tuple(shape), batch, partitions or spark.sparkContext.defaultParallelism)

    class Batches(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sparkvision_batches"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return reader

    spark.dataSource.register(Batches)
    return spark.read.format("sparkvision_batches").load()
