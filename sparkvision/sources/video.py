"""Frames of cameras and videos as a streaming source with offsets.

An offset holds, for each stream, how many of its frames have been taken; what lies between two offsets is always the same
frames, so a query that starts again from its checkpoint loses and repeats none. A task reads at most `per_task` frames of
one stream. Spark asks Python sources for their latest offset without telling them where a query stands, so how much one
micro-batch takes is up to `available`, the function that says what there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id string, frame_id long, data binary"
NAMES = ["stream_id", "frame_id", "data"]


class Frames(InputPartition):
    def __init__(self, stream: str, first: int, end: int):
        super().__init__((stream, first, end))
        self.stream, self.first, self.end = stream, first, end


class Reader(DataSourceStreamReader):
    """`available()` gives the number of frames that each stream has so far, which never falls; `frame(stream, i)` the bytes of
    one of these, and None where it cannot be read. Both run on the cluster, the second in its tasks, perhaps more than once."""

    def __init__(self, available: Callable[[], dict[str, int]], frame: Callable[[str, int], bytes | None], per_task: int):
        self.available, self.frame, self.per_task = available, frame, per_task

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {str(s): int(n) for s, n in self.available().items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for stream, n in sorted(end.items()):
            first = start.get(stream, 0)
            if n < first:
                raise ValueError(f"stream {stream} had {first} frames and has {n}")
            out += [Frames(stream, i, min(i + self.per_task, n)) for i in range(first, n, self.per_task)]
        return out or [Frames("", 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        for i in range(partition.first, partition.end, 64):
            some = range(i, min(i + 64, partition.end))
            yield pa.RecordBatch.from_arrays([pa.array([partition.stream] * len(some)), pa.array(list(some), pa.int64()), pa.array([self.frame(partition.stream, k) for k in some], pa.binary())], names=NAMES)

    def commit(self, end: dict) -> None:
        pass


def read_frames(spark: SparkSession, available: Callable[[], dict[str, int]], frame: Callable[[str, int], bytes | None], per_task: int = 256) -> DataFrame:
    """A stream of (stream_id, frame_id, data): the frames of each stream from 0 on; data is null where one cannot be read."""
    reader = Reader(available, frame, per_task)

    class Video(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sparkvision_frames"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return reader

    spark.dataSource.register(Video)
    return spark.readStream.format("sparkvision_frames").load()
