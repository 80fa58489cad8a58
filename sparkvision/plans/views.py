"""The test tables as the relations that the operators work on, for Spark and, as text, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.package import shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, class_idx, x): one row per element of each tensor."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("class_idx", "v")).select("image_id", "class_idx", F.col("v").cast("double").alias("x"))


LOGITS = "logits AS (SELECT vec_id AS image_id, unnest(range(0, len(embedding))) AS class_idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, c, value): all 64 elements, and eight of 0, as 6 rows of 4 pixels of 3 channels, 0 to 255."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(71))).alias("k"))
    v = F.floor(F.abs(F.coalesce(F.try_element_at("embedding", F.col("k") + 1), F.lit(0.0)).cast("double")) * 1000).cast("int") % 256
    return own.select("image_id", (F.col("k") / 12).cast("int").alias("y"), (F.col("k") / 3 % 4).cast("int").alias("x"), (F.col("k") % 3).alias("c"), v.alias("value"))


GRID = "grid AS (SELECT vec_id AS image_id, k // 12 AS y, k // 3 % 4 AS x, k % 3 AS c, CAST(floor(abs(coalesce(CAST(embedding[k + 1] AS DOUBLE), 0)) * 1000) AS INT) % 256 AS value FROM embeddings, (SELECT unnest(range(72)) AS k))"


def unequal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(image_id, y, row) and (image_id, w, h): each tensor as an image of 2 to 5 pixels a row, as many rows as its elements
    fill, the last one with zeros."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", (F.col("vec_id") % 4 + 2).cast("int").alias("w"))
    own = own.withColumn("h", F.ceil(F.size("embedding") / (F.col("w") * 3)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    at = F.sequence(F.col("y") * F.col("w") * 3, (F.col("y") + 1) * F.col("w") * 3 - 1)
    value = lambda k: F.floor(F.abs(F.coalesce(F.get("embedding", k), F.lit(0.0)).cast("double")) * 1000).cast("int") % 256
    return own.select("image_id", "y", F.transform(at, value).alias("row")), own.select("image_id", "w", "h").distinct()


UNEQUAL = """sizes AS (SELECT vec_id AS image_id, CAST(vec_id % 4 + 2 AS INT) AS w, CAST(ceil(len(embedding) / ((vec_id % 4 + 2) * 3)) AS INT) AS h, embedding AS e FROM embeddings),
unequal AS (SELECT image_id, k // (3 * w) AS y, k // 3 % w AS x, k % 3 AS c, CAST(floor(abs(coalesce(CAST(e[k + 1] AS DOUBLE), 0)) * 1000) AS INT) % 256 AS value FROM (SELECT *, unnest(range(3 * w * h)) AS k FROM sizes))"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, w, h)."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS image_id", "CAST(320 + o_custkey * 37 % 1600 AS INT) AS w", "CAST(240 + o_custkey * 53 % 900 AS INT) AS h")


IMAGES = "images AS (SELECT o_orderkey AS image_id, CAST(320 + o_custkey * 37 % 1600 AS INT) AS w, CAST(240 + o_custkey * 53 % 900 AS INT) AS h FROM orders)"


def raw_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, det_id, pos, x1, y1, x2, y2, score, class_id): boxes in network coordinates, eight orders to an image."""
    columns = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # dealt out by image once, for all that follows
    own = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 8").alias("image_id"), "l_orderkey", "l_linenumber", *columns).repartition("image_id")
    own = own.groupBy("image_id", "l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in columns])
    own = own.selectExpr(
        "image_id",
        "CAST(l_orderkey % 8 * 100 + l_linenumber AS INT) AS det_id",
        "CAST(l_partkey % 600 AS DOUBLE) AS x1",
        "CAST(l_suppkey * 7 % 600 AS DOUBLE) AS y1",
        "l_partkey % 600 + l_quantity * 2 + 8 AS x2",
        "l_suppkey * 7 % 600 + l_quantity * 3 + 8 AS y2",
        "CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS score",
        "CAST(l_partkey % 3 AS INT) AS class_id",
    )
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")) - 1)


RAW_DET = """raw0 AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q, min(l_extendedprice) AS e FROM lineitem GROUP BY 1, 2),
raw_det AS (SELECT l_orderkey // 8 AS image_id, CAST(l_orderkey % 8 * 100 + l_linenumber AS INT) AS det_id, CAST(p % 600 AS DOUBLE) AS x1, CAST(s * 7 % 600 AS DOUBLE) AS y1,
  p % 600 + q * 2 + 8 AS x2, s * 7 % 600 + q * 3 + 8 AS y2, CAST(CAST(floor(e * 100) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS score, CAST(p % 3 AS INT) AS class_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey % 8 * 100 + l_linenumber) - 1 AS INT) AS pos FROM raw0)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, iter, seq, layer, ms): layer timings; the iteration is the number of the layer's sample in its run."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (F.row_number().over(w) - 1).alias("iter"), F.col("event_id").alias("seq"), F.col("event_type").alias("layer"), F.col("value").alias("ms"))


SAMPLES = "samples AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INT) AS iter, event_id AS seq, event_type AS layer, value AS ms FROM events)"


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slice_id, layer, t0, t1): ten minutes from each purchase, in seconds."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("slice_id"), F.concat(F.lit("layer"), (F.col("user_id") % 10).cast("string")).alias("layer"), t.alias("t0"), (t + 600).alias("t1"), F.col("value").alias("ms"))


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, mw): power samples."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select((F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"), (F.col("value") * 100).alias("mw"))


SLICES = """slices AS (SELECT event_id AS slice_id, 'layer' || CAST(user_id % 10 AS VARCHAR) AS layer, epoch_us(ts) / 1e6 AS t0, epoch_us(ts) / 1e6 + 600 AS t1, value AS ms FROM events WHERE event_type = 'purchase'),
power AS (SELECT epoch_us(ts) / 1e6 AS ts, value * 100 AS mw FROM events WHERE event_type = 'error')"""


#: Keys in a block of layers.
KEYS = 4096


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(net, idx, name, type, size, compat): the layers of 25 networks, one per brand, in key order. A layer's place is that
    in its block of keys and the number of layers in the blocks before, so no task holds a network."""
    own = table(spark, sf_dir, "part").withColumn("_block", F.floor(F.col("p_partkey") / KEYS))
    before = F.sum("_n").over(Window.partitionBy("p_brand").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = own.groupBy("p_brand", "_block").agg(F.count("*").alias("_n")).select(F.col("p_brand").alias("_brand"), F.col("_block").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = own.withColumn("_place", F.row_number().over(Window.partitionBy("p_brand", "_block").orderBy("p_partkey")))
    own = own.join(blocks, F.col("p_brand").eqNullSafe(F.col("_brand")) & F.col("_block").eqNullSafe(F.col("_at")))
    return own.select(F.col("p_brand").alias("net"), (F.col("_before") + F.col("_place") - 1).cast("int").alias("idx"), F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"), (F.col("p_size") % 4 > 0).alias("compat"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("key"))


LAYERS = "layers AS (SELECT p_brand AS net, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS idx, p_name || '_' || CAST(p_partkey AS VARCHAR) AS name, p_type AS type, CAST(p_size AS BIGINT) AS size, p_size % 4 > 0 AS compat, p_retailprice AS price, p_partkey AS key FROM part)"
