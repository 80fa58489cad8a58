"""Queries that write a table into the shared folder in one of the library's formats and read it back, and other sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import image, profiling
from ..sources import batcher, catalog, files, parts, scan
from ..sources.package import shared_dir
from . import views
from .image_queries import resample_sql, small_images
from .profiling_queries import TOTALS, paired
from .registry import query


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {views.GRID} SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(c AS INT) AS c, value FROM grid")
def decoded_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of raw bytes through a decoder, as pixels."""
    byte = F.lpad(F.hex("value"), 2, "0")
    at = F.col("y") * 12 + F.col("x") * 3 + F.col("c")
    raw = views.grid(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), byte.alias("byte")))).alias("b"))
    own = raw.select(F.col("image_id").cast("string").alias("path"), F.unhex(F.array_join(F.col("b.byte"), "")).alias("content"))
    out = files.pixels(files.decoded_images(own, lambda content: (6, 4, content)))
    return out.select(F.col("image_id").cast("long").alias("image_id"), "y", F.col("x").cast("int").alias("x"), F.col("c").cast("int").alias("c"), "value")


def written_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a catalogue: a folder for each brand, in it a JSON object of name -> settings."""
    at = place(spark, "catalog")
    own = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("model"), F.create_map(F.lit("url"), F.col("p_type"), F.lit("imgsz"), F.col("p_size").cast("string")).alias("config"))
    catalog.write_catalog(own, at)
    return catalog.read_catalog(spark, at)


@query("SELECT p_brand AS family, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS model, p_type AS url, p_size AS imgsz FROM part")
def catalog_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_catalog(spark, sf_dir).select("family", "model", F.col("config.url").alias("url"), F.col("config.imgsz").cast("int").alias("imgsz"))


@query("SELECT DISTINCT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS model FROM part")
def supported_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.supported_models(written_catalog(spark, sf_dir))


@query(f"""WITH {TOTALS}, p AS (SELECT run_id, layer, avg(ms) AS mean, min(ms) AS minimum, max(ms) AS maximum, min(seq) AS f FROM last_ GROUP BY 1, 2),
w AS (SELECT run_id, count(*) AS iterations, avg(total) AS total_mean FROM totals GROUP BY 1)
SELECT run_id, iterations, round(total_mean, 6) AS total_mean, row_number() OVER (PARTITION BY run_id ORDER BY f) AS place, layer, round(mean, 6) AS mean, minimum, maximum FROM p JOIN w USING (run_id)""")
def profile_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as JSON lines, one a run, and their layers again."""
    at, samples = place(spark, "profile"), paired(spark, sf_dir)
    files.write_profile(profiling.layer_profile(samples), profiling.iteration_totals(samples), at)
    own = spark.read.schema(files.PROFILE).json(at).select("run_id", "iterations", F.round("total_time.mean", 6).alias("total_mean"), F.explode("layers").alias("l"))
    return own.select("run_id", "iterations", "total_mean", F.col("l.place").alias("place"), "l.layer", F.round("l.mean", 6).alias("mean"), "l.minimum", "l.maximum")


@query("""SELECT p_brand AS framework, p_type AS model, CAST(p_size AS VARCHAR) AS key, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS min, max(p_retailprice) AS max FROM part GROUP BY 1, 2, 3""")
def store_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark results as nested JSON, and again as rows."""
    at, x = place(spark, "store"), "p_retailprice"
    metrics = F.struct(F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"))
    own = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("framework"), F.col("p_type").alias("model"), F.col("p_size").cast("string").alias("key")).agg(metrics.alias("metrics"))
    files.write_store(own, at)
    return files.read_store(spark, at).select("framework", "model", "key", F.round("metrics.mean", 6).alias("mean"), F.col("metrics.min").alias("min"), F.col("metrics.max").alias("max"))


@query(f"WITH {views.GRID}, {resample_sql(6, 6, 4, 6, 4, 6, 1, 0)} SELECT image_id AS batch_id, CAST(c * 36 + y * 6 + x AS INT) AS place, round(value / 255.0::DOUBLE, 5) AS value FROM small")
def calibration_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared images as calibration batches, written and read."""
    at = place(spark, "calibration")
    own = image.preprocessed(views.grid(spark, sf_dir), small_images(spark, sf_dir), 6, 6, swap_rb=False)
    data = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"])
    own = own.groupBy(F.col("image_id").alias("batch_id")).agg(F.array(*map(F.lit, (1, 3, 6, 6))).alias("shape"), data.alias("data"))
    files.write_batches(own, at)
    return files.read_batches(spark, at).select("batch_id", F.posexplode("data").alias("place", "value")).withColumn("value", F.round("value", 5))


CACHE = """WITH c AS (SELECT p_name || CAST(p_partkey AS VARCHAR) AS name, unnest(['engine', 'onnx']) AS ext, p_type AS payload FROM part),
e AS (SELECT p_name || CAST(p_partkey AS VARCHAR) AS name, unnest(['onnx', 'cache']) AS ext, p_brand AS payload FROM part WHERE p_size > 20)"""


def cache_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An engine and a network for each part, and new networks and calibration caches for the larger ones."""
    own = views.table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.col("p_partkey").cast("string")))
    rows = lambda df, endings, payload: df.select("name", F.explode(F.array(*map(F.lit, endings))).alias("ext"), F.col(payload).alias("payload"))
    return rows(own, ("engine", "onnx"), "p_type"), rows(own.where("p_size > 20"), ("onnx", "cache"), "p_brand")


@query(f"{CACHE} SELECT * FROM c UNION ALL SELECT * FROM e ANTI JOIN c USING (name, ext)")
def cache_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.put_in_cache(*cache_parts(spark, sf_dir))


@query(f"{CACHE} SELECT * FROM c ANTI JOIN e USING (name, ext) UNION ALL SELECT * FROM e")
def cache_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.put_in_cache(*cache_parts(spark, sf_dir), overwrite=True)


@query("SELECT CAST(n_nationkey AS BIGINT) AS batch_id, '4,3' AS shape, CAST(unnest(range(12)) AS INT) AS place, CAST(n_nationkey * 12 + unnest(range(12)) AS DOUBLE) / 2 AS value FROM nation")
def batcher_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that a user's function makes, through a data source; one for each nation."""
    n = views.table(spark, sf_dir, "nation").count()
    own = batcher.read(spark, n, (4, 3), lambda i: [(i * 12 + k) / 2 for k in range(12)])
    return own.select("batch_id", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), F.posexplode("data").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


@query(f"SELECT p_partkey AS input_id, CAST(k AS INT) AS place, round(CAST(CASE WHEN p_size % 2 = 0 THEN 0 ELSE {catalog.uniform_sql('p_partkey', 'k', 7)} END AS FLOAT)::DOUBLE, 6) AS value FROM (SELECT *, unnest(range(3 * p_size)) AS k FROM part)")
def random_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each random input, all 0 for whole-number types."""
    specs = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("input_id"), F.array(F.lit(3), F.col("p_size")).alias("shape"), F.when(F.col("p_size") % 2 == 0, "int32").otherwise("float32").alias("dtype"))
    own = catalog.random_inputs(specs, seed=7)
    return own.select("input_id", F.posexplode("data").alias("place", "v")).select("input_id", "place", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("SELECT o_orderkey AS batch_id, '1,3,4,4' AS shape, 48 AS n, TRUE AS in_range FROM orders")
def synthetic_batch_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every synthetic batch, whatever its values."""
    own = catalog.synthetic_batches(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id")), (1, 3, 4, 4), -1.0, 1.0, seed=42)
    return own.select("batch_id", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), F.size("data").alias("n"), F.forall("data", lambda v: (v >= -1) & (v < 1)).alias("in_range"))


@query("SELECT p_brand AS framework, p_type AS model, CAST(p_size AS VARCHAR) AS key, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS min, max(p_retailprice) AS max FROM part WHERE p_size > 10 GROUP BY 1, 2, 3")
def parts_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark results as a store in parts, replaced by fewer ones."""
    at, x = place(spark, "parts"), "p_retailprice"
    metrics = F.struct(F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"))
    own = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("framework"), F.col("p_type").alias("model"), F.col("p_size").alias("size"), F.col("p_size").cast("string").alias("key")).agg(metrics.alias("metrics"))
    parts.write_parts(own.where("size % 2 = 0"), at)
    parts.write_parts(own.where("size > 10"), at)
    return parts.read_parts(spark, at).select("framework", "model", "key", F.round("metrics.mean", 6).alias("mean"), F.col("metrics.min").alias("min"), F.col("metrics.max").alias("max"))


def halved(batches):
    """A model that cannot take errors."""
    for b in batches:
        if (b.event_type == "error").any():
            raise ValueError(f"no {b.event_type[b.event_type == 'error'].iloc[0]}s, please")
        yield b.assign(score=b.value / 2)[["event_id", "score"]]


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN value / 2 END AS score, CASE WHEN event_type = 'error' THEN 'ValueError: no errors, please' END AS error, CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) END AS user FROM events")
def failures_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails on some rows loses only these."""
    own = views.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    results, dead, counts = files.survived(own, halved, "event_id long, score double", place(spark, "survived"))
    if counts["results"] + counts["failures"] != own.count():
        raise ValueError(f"rows are missing: {counts}")
    return results.select("event_id", "score", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("user")).unionByName(dead.select("event_id", F.lit(None).cast("double").alias("score"), "error", F.col("user_id").cast("string").alias("user")))


@query("SELECT p_partkey || '.png' AS name, length(p_name) * p_size AS size, repeat(p_name, p_size) AS content FROM part WHERE p_size % 2 = 0 AND length(p_name) * p_size > 100")
def scanned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part, of which the larger images are read."""
    at = place(spark, "images")
    fs, folder = parts.opened(at)
    fs.create_dir(folder, recursive=True)

    def put(batches):
        own, to = parts.opened(at)
        for b in batches:
            for name, text in zip(b.name, b.text, strict=True):
                with own.open_output_stream(f"{to}/{name}") as f:
                    f.write(text.encode())
            yield b[["name"]]

    ending = F.when(F.col("p_size") % 2 == 0, ".png").otherwise(".txt")
    own = views.table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), ending).alias("name"), F.expr("repeat(p_name, p_size)").alias("text"))
    own.mapInPandas(put, "name string").count()
    found = scan.scan(spark, at).where(F.col("name").endswith(".png") & (F.col("size") > 100))
    return found.select("name", "size", F.decode("content", "UTF-8").alias("content"))


@query(f"""{CACHE}, a AS (SELECT name, CAST(NULL AS VARCHAR) AS missing FROM c UNION SELECT DISTINCT p_brand, 'x' FROM part)
SELECT a.name, arg_min(ext, list_position(['cache', 'onnx', 'engine'], ext)) AS ext, arg_min(payload, list_position(['cache', 'onnx', 'engine'], ext)) AS payload FROM a LEFT JOIN (SELECT * FROM c ANTI JOIN e USING (name, ext) UNION ALL SELECT * FROM e) k USING (name) GROUP BY 1""")
def cache_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each name, some of which aren't there, the entry with the preferred ending."""
    old, new = cache_parts(spark, sf_dir)
    asked = old.select("name").union(views.table(spark, sf_dir, "part").select("p_brand")).distinct()
    return files.first_in_cache(files.put_in_cache(old, new, overwrite=True), asked, ("cache", "onnx", "engine"))


@query(f"{CACHE} SELECT * FROM c ANTI JOIN (SELECT name, ext FROM e WHERE ext = 'onnx') USING (name, ext)")
def cache_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = cache_parts(spark, sf_dir)
    return files.entries_removed(old, new.where("ext = 'onnx'").select("name", "ext"))
