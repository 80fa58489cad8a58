"""Queries that run a stream over all that its source holds, and give what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import video
from ..sources.package import shared_dir
from ..streaming import frames, retrieval
from . import views
from .registry import query


def ran(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream to its end in the shared folder and reads its table."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frames.submitted(stream, lambda s: s, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = views.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


@query("SELECT user_id AS stream_id, event_id AS frame_id, event_type AS model, value * 2 AS score FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT user_id, event_id, 'other', value FROM events WHERE event_type NOT IN ('click', 'view')")
def stream_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, each with its own model, into one table."""
    own = source(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_id"), "event_type", "value")
    mine = F.col("event_type").isin("click", "view")
    one = own.where(mine).select("stream_id", "frame_id", F.col("event_type").alias("model"), (F.col("value") * 2).alias("score"))
    two = own.where(~mine).select("stream_id", "frame_id", F.lit("other").alias("model"), F.col("value").alias("score"))
    return ran(spark, frames.fanned_in([one, two]), "fan-in")


@query("SELECT c_nationkey AS model_id, c_custkey AS stream_id, event_id AS frame_id, value FROM events JOIN customer ON c_custkey = user_id")
def stream_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a stream to the models that want them."""
    own = source(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_id"), "value")
    models = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("model_id"), F.col("c_custkey").alias("stream_id"))
    return ran(spark, frames.by_model(own, models).select("model_id", "stream_id", "frame_id", "value"), "by-model")


@query("""WITH w AS (SELECT event_type AS engine, time_bucket(INTERVAL 1 HOUR, ts) AS b, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2)
SELECT engine, epoch_ms(b) // 1000 AS start, n, total FROM w WHERE b + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    own = frames.windowed_latency(source(spark, sf_dir, "events"))
    out = ran(spark, own.select("engine", F.unix_seconds("w.start").alias("start"), "n", "total"), "windows")
    return out.select("engine", "start", "n", F.round("total", 6).alias("total"))


@query("""WITH t AS (SELECT user_id AS model_id, epoch_us(ts) / 1e6 AS t0, epoch_us(ts) / 1e6 + value AS t1, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6 + value DESC, ts DESC) AS r FROM events)
SELECT model_id, t0, t1, round(t1 - t0, 4) AS seconds FROM t WHERE r = 1""")
def last_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    own = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("model_id"), t.alias("t0"), (t + F.col("value")).alias("t1"))
    return frames.last_timing(own).withColumn("seconds", F.round("seconds", 4))


#: Frames by user; errors never arrive. What is missing is given up a day after a later frame, and frames may be an hour late.
WAIT_MS, LATE = 86_400_000, "1 hour"
FRAMES = f"""frames AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_id, event_type <> 'error' AS here, epoch_us(ts) // 1000 AS ms, value FROM events),
mark AS (SELECT max(ms) - 3600000 AS mark FROM frames WHERE here),
due AS (SELECT *, min(CASE WHEN here THEN ms END) OVER (PARTITION BY stream_id ORDER BY frame_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {WAIT_MS} AS deadline FROM frames),
stops AS (SELECT stream_id, min(CASE WHEN NOT here AND (deadline IS NULL OR deadline > mark) THEN frame_id END) AS stop FROM due, mark GROUP BY 1)"""


@query(f"WITH {FRAMES} SELECT stream_id, frame_id, here AS arrived, CASE WHEN here THEN value END AS value FROM due JOIN stops USING (stream_id) WHERE stop IS NULL OR frame_id < stop")
def stream_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's frames in their order, with nulls for those that did not come in time."""
    at = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    own = views.table(spark, sf_dir, "events").withColumns({"frame_id": number, "ts": F.col("ts").cast("timestamp")})
    own.where("event_type <> 'error'").select(F.col("user_id").alias("stream_id"), "frame_id", "ts", "value").repartition(F.xxhash64("frame_id")).write.parquet(at)
    stream = retrieval.in_order(spark.readStream.schema(spark.read.parquet(at).schema).parquet(at), WAIT_MS, LATE)
    return ran(spark, stream.select("stream_id", "frame_id", "arrived", "value"), "in-order")


@query("""SELECT a.event_id AS frame_id, a.value AS result_half, b.value * 2 AS result_whole, c.value + 1 AS result_int8 FROM events a JOIN events b ON b.event_id = a.event_id JOIN events c ON c.event_id = a.event_id
WHERE b.event_type <> 'error' AND c.event_type <> 'click' AND epoch_us(a.ts) + a.user_id % 90 * 1000000 <= epoch_us(a.ts) + 60000000""")
def stream_lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three engines, of which two leave frames out and one is slow: a frame leaves when all have answered within a minute."""
    own = source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    slow = F.timestamp_micros(F.unix_micros("ts") + F.col("user_id") % 90 * 1_000_000)
    answers = [own.select(F.col("event_id").alias("frame_id"), "ts", F.col("value").alias("result")),
        own.where("event_type <> 'error'").select(F.col("event_id").alias("frame_id"), "ts", (F.col("value") * 2).alias("result")),
        own.where("event_type <> 'click'").select(F.col("event_id").alias("frame_id"), slow.alias("ts"), (F.col("value") + 1).alias("result"))]
    out = retrieval.in_lockstep(answers, ["half", "whole", "int8"], ["frame_id"], "1 minute", "1 hour")
    return ran(spark, out.drop("ts"), "lockstep")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS frame_id, c_custkey AS customer, lower(hex(encode(CAST(c_nationkey AS VARCHAR) || ':' || CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS VARCHAR)))) AS data FROM customer")
def stream_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each nation with a frame for each of its customers, read as a stream and joined to them."""
    own = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("stream_id"), F.col("c_custkey").alias("customer"))
    own = own.withColumn("frame_id", (F.row_number().over(Window.partitionBy("stream_id").orderBy("customer")) - 1).cast("long"))
    lengths = {r.stream_id: r["count"] for r in own.groupBy("stream_id").count().collect()}  # a number a nation
    frames_ = video.read_frames(spark, lambda: lengths, lambda stream, i: f"{stream}:{i}".encode())
    out = frames_.join(own, ["stream_id", "frame_id"])
    return ran(spark, out.select("stream_id", "frame_id", "customer", F.lower(F.hex("data")).alias("data")), "camera")


@query("""SELECT 'wide' AS model_id, user_id AS stream_id, event_id AS frame_id, round(value * 2 + 1, 6) AS score FROM events WHERE user_id % 3 < 2
UNION ALL SELECT 'narrow', user_id, event_id, round(value / 2 - 1, 6) FROM events WHERE user_id % 3 > 0""")
def stream_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models, each with two steps, over streams of which some go to both."""
    own = source(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_id"), "value")
    k = F.col("stream_id") % 3
    wanted = F.array_compact(F.array(F.when(k < 2, "wide"), F.when(k > 0, "narrow")))
    models = {"wide": lambda b: b.assign(score=b.value * 2), "narrow": lambda b: b.assign(score=b.value / 2)}
    second = {"wide": lambda b: b.assign(score=(b.score + 1).round(6))[COLUMNS], "narrow": lambda b: b.assign(score=(b.score - 1).round(6))[COLUMNS]}
    out = frames.scored_by_model(own.withColumn("model_id", F.explode(wanted)), models, "model_id string, stream_id long, frame_id long, score double", second, whole=True)
    return ran(spark, out, "side-by-side")


COLUMNS = ["model_id", "stream_id", "frame_id", "score"]
