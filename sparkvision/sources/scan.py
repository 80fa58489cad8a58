"""Files of a folder as a data source: filters on names and sizes decide before anything is read, and tasks read about equally
many bytes. Contents are never sorted or shuffled.

Only metadata reaches the driver: a name and a size for each file of the folder that passes the filters. The folder may be
anything that pyarrow's file systems open, shared by all executors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from .package import shipped
from .parts import opened

SCHEMA = "name string, size long, content binary"
#: Bytes and files of a task, and bytes of a batch of rows.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 64 << 20, 10_000, 8 << 20
TESTS = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


def understood(f: Filter) -> tuple[str, type, object, bool] | None:
    """(column, kind, value, negated) of a filter that names and sizes decide."""
    inner, negated = (f.child, True) if isinstance(f, Not) else (f, False)
    if type(inner) not in TESTS or tuple(inner.attribute) not in (("name",), ("size",)):
        return None
    value = getattr(inner, "values", None) if isinstance(inner, In) else inner.value
    if value is None or isinstance(inner, In) and any(v is None for v in value):
        return None
    return inner.attribute[0], type(inner), value, negated


def balanced(files: list[tuple[str, int]], most_bytes: int, most_files: int) -> list[list[tuple[str, int]]]:
    """The largest first, each to the task that has the fewest bytes; a task has most_bytes on average and most_files at most."""
    if not files:
        return []
    n = max(-(-sum(size for _, size in files) // most_bytes), -(-len(files) // most_files), 1)
    tasks: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    heap = [(0, 0, k) for k in range(n)]
    for name, size in sorted(files, key=lambda f: (-f[1], f[0])):
        total, count, k = heapq.heappop(heap)
        tasks[k].append((name, size))
        if count + 1 < most_files:
            heapq.heappush(heap, (total + size, count + 1, k))
        elif not heap:
            tasks.append([])
            heap = [(0, 0, len(tasks) - 1)]
    return [t for t in tasks if t]


class Reader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str], most_bytes: int):
        self.folder, self.columns, self.most_bytes = folder, columns, most_bytes
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            test = understood(f)
            if test:
                self.tests.append(test)
            else:
                yield f

    def passes(self, name: str, size: int) -> bool:
        row = {"name": name, "size": size}
        return all(TESTS[kind](row[column], value) != negated for column, kind, value, negated in self.tests)

    def partitions(self) -> Sequence[InputPartition]:
        fs, at = opened(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=False))
        files = [(f.base_name, f.size) for f in found if f.type == pyarrow.fs.FileType.File and self.passes(f.base_name, f.size)]
        return [Files(t) for t in balanced(files, self.most_bytes, TASK_FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, at = opened(self.folder)
        rows: list[tuple] = []
        held = 0
        for name, size in partition.files:
            if "content" in self.columns:
                with fs.open_input_stream(f"{at}/{name}") as f:
                    rows.append((name, size, f.read()))
            else:
                rows.append((name, size, None))
            held += size
            if held > BATCH_BYTES or len(rows) >= 1000:
                yield batch_of(rows, self.columns)
                rows, held = [], 0
        if rows:
            yield batch_of(rows, self.columns)


def batch_of(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    kinds = {"name": (0, pa.string()), "size": (1, pa.int64()), "content": (2, pa.binary())}
    return pa.RecordBatch.from_arrays([pa.array([r[kinds[c][0]] for r in rows], kinds[c][1]) for c in columns], names=columns)


def scan(spark: SparkSession, folder: str, contents: bool = True, most_bytes: int = TASK_BYTES) -> DataFrame:
    """(name, size, content) of the folder's own files, without content if it isn't wanted. Comparisons of name or size with
    constants, and `startswith`, `endswith`, `contains` and `isin` on names, are decided before files are opened."""
    columns = ["name", "size", "content"] if contents else ["name", "size"]
    schema = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in columns)

    class Scan(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sparkvision_scan"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(folder, columns, most_bytes)

    shipped(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Scan)
    return spark.read.format("sparkvision_scan").load()
