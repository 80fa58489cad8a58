"""A benchmark store in parts, replaced whole or not at all.

Each (framework, model) is a part: a file of JSON lines, one for each key, which a task writes row by row. A list of the
parts, put in place by one move when all tasks have succeeded, is the store; until then, and if the job is aborted, the old
list and its files stand. The folder may be anything that pyarrow's file systems open: it must be shared by all executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .package import shipped

LIST = "_parts.json"
COLUMNS = ["framework", "model", "key", "metrics"]
ROWS = "framework string, model string, key string, metrics struct<mean: double, median: double, min: double, max: double>"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def listed(path: str) -> list[str]:
    """The file names of the store's parts; none where there is no store."""
    fs, at = opened(path)
    if fs.get_file_info(f"{at}/{LIST}").type == pyarrow.fs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{at}/{LIST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = opened(self.path)
        names, part, out = [], None, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if (row["framework"], row["model"]) != part:
                        if out:
                            out.close()
                        part = row["framework"], row["model"]
                        names.append(f"{self.job}-{uuid.uuid4().hex}.json")
                        out = fs.open_output_stream(f"{at}/{names[-1]}")
                    out.write((json.dumps({c: row[c] for c in COLUMNS}) + "\n").encode())
        except BaseException:
            if out:
                out.close()
            removed(fs, at, names)
            raise
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        old, new = listed(self.path), sorted(n for m in messages if m for n in m.names)
        with fs.open_output_stream(f"{at}/{self.job}.list") as f:
            f.write(json.dumps(new).encode())
        fs.move(f"{at}/{self.job}.list", f"{at}/{LIST}")
        removed(fs, at, old)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        removed(fs, at, [n for m in messages if m for n in m.names])


def removed(fs: pyarrow.fs.FileSystem, at: str, names: list[str]) -> None:
    for name in names:
        if fs.get_file_info(f"{at}/{name}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(f"{at}/{name}")


def write_parts(rows: DataFrame, path: str) -> None:
    """Replaces the store at path by rows (framework, model, key, metrics), of which a key has one."""
    fs, at = opened(path)
    fs.create_dir(at, recursive=True)

    class Parts(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sparkvision_parts"

        def writer(self, schema, overwrite: bool) -> Writer:
            return Writer(path)

    spark = shipped(rows.sparkSession)
    spark.dataSource.register(Parts)
    own = rows.select(*COLUMNS).repartition("framework", "model").sortWithinPartitions("framework", "model", "key")
    own.write.format("sparkvision_parts").mode("append").save()


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows as they were at the last commit."""
    names = listed(path)
    root = path if "://" in path else f"file://{path.removeprefix('file:')}"
    return spark.read.schema(ROWS).json([f"{root}/{n}" for n in names]) if names else spark.createDataFrame([], ROWS)
