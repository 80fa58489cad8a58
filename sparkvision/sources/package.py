"""Makes the library importable where Spark's Python workers run."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch; Spark's default of 10000 long texts would be hundreds of megabytes at once.
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CHECKPOINTS = "spark.checkpoint.dir"
ROOT = str(Path(__file__).resolve().parents[2])


def shipped(spark: SparkSession) -> SparkSession:
    """Adds this copy of the library to the workers' PYTHONPATH. On a cluster without a shared installation, also give
    the package to Spark with --py-files."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))
    if spark.conf.get(RECORDS) == "10000":
        spark.conf.set(RECORDS, "1000")
    return spark


def cleared(spark: SparkSession) -> None:
    """Deletes all that this application has put into the shared folder: tables that were written and read back, streams'
    checkpoints. For when no result that reads them is wanted any more."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; only in local mode, where driver and executors are one process, a
    local one of our own if the setting is missing."""
    found = spark.conf.get(CHECKPOINTS, None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINTS} must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sparkvision-")
        spark.conf.set(CHECKPOINTS, found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"
