"""Tables that cut lineage: written to, and read again from, the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..sources.package import shared_dir


#: What written() and reused() keep, until dropped() or freed().
_kept: list[DataFrame] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _kept.append(out)
    return out


def reused(df: DataFrame) -> DataFrame:
    """Keep df on the executors' disks while several steps read it. What a lost executor held is computed anew; written()
    is for what that would make expensive."""
    out = df.persist(StorageLevel.DISK_ONLY)
    out._scratch_path = None
    _kept.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() and reused() that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        if context._jsc is None:  # its session has ended
            pass
        elif df._scratch_path is None:
            df.unpersist()
        else:
            at = context._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        _kept[:] = [x for x in _kept if x is not df]


def kept() -> list[DataFrame]:
    """What written() and reused() have kept so far."""
    return list(_kept)


def freed(before: list[DataFrame], *but: DataFrame) -> None:
    """Delete what written() and reused() have kept since `before`, but for these tables: for when the results that are
    computed from it have been written or are no longer wanted."""
    dropped(*[x for x in _kept if not any(x is y for y in (*before, *but))])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def for_bytes(spark: SparkSession, total: int, each: int) -> int:
    """Partitions that keep `each` bytes to a task, the session's number at least."""
    return max(parts(spark), -(-int(total or 0) // each))
