"""Streams of frames: what queues and worker threads do elsewhere, as Structured Streaming.

A file source gives rows in micro-batches; frames keep their (stream_id, frame_id), so any order can be restored; back
pressure is maxFilesPerTrigger; a model is a function on batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def frames(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream over the Parquet files at path, with the schema that they have now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def submitted(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs what has arrived through a stateless transform into a Parquet table, exactly once, and stops."""
    return transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_latency(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean and count per engine and event-time window; rows later than the watermark are left out."""
    own = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("engine")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def fanned_in(streams: list[DataFrame]) -> DataFrame:
    """Many streams as one; each row keeps its stream_id and frame_id."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def by_model(frames_: DataFrame, models: DataFrame) -> DataFrame:
    """Each frame to each model that wants it (models: model_id, stream_id)."""
    return frames_.join(models, "stream_id")


#: A model on a batch of one model's frames, and what turns its raw results into the rows that are wanted.
Model = Callable[[pd.DataFrame], pd.DataFrame]


def scored_by_model(frames_: DataFrame, models: dict[str, Model], schema: str, postprocess: dict[str, Model] | None = None, whole: bool = False) -> DataFrame:
    """Several models side by side: each frame (with model_id) through its own model, batch by batch, and with `postprocess`
    through its model's second step. `whole` asks for both steps of every model, so each needs a second one. A frame for a model
    that isn't there is an error."""
    second = postprocess or {}
    lacking = sorted(set(models) - set(second)) if whole else sorted(set(second) - set(models))
    if lacking:
        raise ValueError(f"no {'second step' if whole else 'model'} for {', '.join(lacking)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("model_id", sort=False):
                if name not in models:
                    raise ValueError(f"no model {name}")
                out = models[name](own)
                yield second[name](out) if name in second else out

    return frames_.where("model_id IS NOT NULL").mapInPandas(run, schema)


def last_timing(timings: DataFrame) -> DataFrame:
    """Of each model the (t0, t1, seconds) of its last inference."""
    last = timings.groupBy("model_id").agg(F.max_by(F.struct("t0", "t1"), F.struct("t1", "t0")).alias("s"))
    return last.select("model_id", "s.t0", "s.t1", (F.col("s.t1") - F.col("s.t0")).alias("seconds"))
