"""Queries over benchmark results, settings and the model catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import benchmarks
from ..sources import catalog
from . import views
from .registry import query

POINTS = "points AS (SELECT p_brand AS family, p_partkey AS point_id, p_retailprice AS cost, CAST(p_size AS DOUBLE) AS acc FROM part)"


@query(f"""WITH {POINTS}, s AS (SELECT *, max(acc) OVER (PARTITION BY family ORDER BY cost, acc DESC, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM points),
f AS (SELECT * FROM s WHERE before IS NULL OR acc > before + 1e-9),
hidden AS (SELECT DISTINCT p.family, p.point_id FROM f p JOIN f a ON a.family = p.family AND a.cost < p.cost AND a.acc < p.acc JOIN f b ON b.family = p.family AND b.cost > p.cost WHERE (p.acc - a.acc) * (b.cost - p.cost) + 1e-9 < (b.acc - p.acc) * (p.cost - a.cost))
SELECT p.family, p.point_id, p.cost, p.acc, f.point_id IS NOT NULL AND h.point_id IS NULL AS frontier FROM points p LEFT JOIN f ON f.point_id = p.point_id LEFT JOIN hidden h ON h.point_id = p.point_id""")
def pareto_frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.table(spark, sf_dir, "part").selectExpr("p_brand AS family", "p_partkey AS point_id", "p_retailprice AS cost", "CAST(p_size AS DOUBLE) AS acc")
    return benchmarks.pareto(points).select("family", "point_id", "cost", "acc", "frontier")


PREFIXES = ["Brand#1", "Brand#2", "Brand#3"]


@query("""WITH b AS (SELECT l_partkey AS model, median(l_extendedprice) AS med FROM lineitem GROUP BY 1), i AS (SELECT p_partkey AS model, p_brand AS name, CASE WHEN p_size % 7 > 0 THEN p_size END AS acc FROM part)
SELECT model, CASE WHEN name LIKE 'Brand#1%' THEN 'Brand#1' WHEN name LIKE 'Brand#2%' THEN 'Brand#2' WHEN name LIKE 'Brand#3%' THEN 'Brand#3' END AS family, acc, round(med, 6) AS median FROM b JOIN i USING (model)
WHERE acc IS NOT NULL AND (name LIKE 'Brand#1%' OR name LIKE 'Brand#2%' OR name LIKE 'Brand#3%')""")
def pareto_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined to model facts; models without an accuracy or of no known family go."""
    results = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("model")).agg(F.round(F.median("l_extendedprice"), 6).alias("median"))
    facts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), benchmarks.first_prefix(F.col("p_brand"), PREFIXES).alias("family"), F.when(F.col("p_size") % 7 > 0, F.col("p_size")).alias("acc"))
    return results.join(facts, "model").where("acc IS NOT NULL AND family <> 'unknown' AND median IS NOT NULL").select("model", "family", "acc", "median")


@query("SELECT o_orderkey AS run_id, o_custkey AS model FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_discount > 0.05) USING (o_orderkey)")
def remaining_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("model"))
    done = views.table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("run_id"))
    return benchmarks.remaining(work, done, ["run_id"])


@query("""WITH o AS (SELECT p_partkey AS k, p_retailprice AS v FROM part), n AS (SELECT s_suppkey * 3 AS k, max(s_acctbal) AS v FROM supplier GROUP BY 1)
SELECT k, v FROM o ANTI JOIN n USING (k) UNION ALL SELECT k, v FROM n""")
def store_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    new = views.table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") * 3).alias("k")).agg(F.max("s_acctbal").alias("v"))
    return benchmarks.stored(old, new, ["k"])


@query("""WITH o AS (SELECT p_partkey AS k, p_retailprice AS v FROM part), n AS (SELECT s_suppkey * 3 AS k, max(s_acctbal) AS v FROM supplier GROUP BY 1)
SELECT k, v FROM o UNION ALL SELECT k, v FROM n ANTI JOIN o USING (k)""")
def store_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    new = views.table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") * 3).alias("k")).agg(F.max("s_acctbal").alias("v"))
    return benchmarks.stored(old, new, ["k"], overwrite=False)


GRID = "(SELECT a.v AS preproc, b.v AS graph, c.v AS pagelocked, d.v AS unified FROM (SELECT unnest(['cpu', 'cuda', 'trt']) AS v) a, (SELECT unnest([FALSE, TRUE]) AS v) b, (SELECT unnest([FALSE, TRUE]) AS v) c, (SELECT unnest([FALSE, TRUE]) AS v) d WHERE NOT (c.v AND d.v))"


def grid(devices: DataFrame) -> DataFrame:
    """The 18 settings that can be combined, for each device."""
    both = F.array(F.lit(False), F.lit(True))
    own = devices.select("*", F.explode(F.array(F.lit("cpu"), F.lit("cuda"), F.lit("trt"))).alias("preproc"))
    own = own.withColumn("graph", F.explode(both)).withColumn("pagelocked", F.explode(both)).withColumn("unified", F.explode(both))
    return own.where("NOT (pagelocked AND unified)")


@query(f"SELECT s_name AS device, preproc, graph, pagelocked, unified FROM supplier, {GRID}")
def optimisation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(views.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("device")))


@query("""WITH m AS (SELECT c_nationkey AS device, c_mktsegment AS config, avg(c_acctbal + 2000) AS mean FROM customer GROUP BY 1, 2)
SELECT device, config, round(mean, 6) AS mean, CAST(row_number() OVER (PARTITION BY device ORDER BY mean, config) AS INT) AS rank, round(max(mean) OVER (PARTITION BY device) / min(mean) OVER (PARTITION BY device), 6) AS best_speedup FROM m""")
def ranked_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("device"), F.col("c_mktsegment").alias("config")).agg(F.avg(F.col("c_acctbal") + 2000).alias("mean"))
    return benchmarks.ranked(own, "device").select("device", "config", F.round("mean", 6).alias("mean"), "rank", F.round("best_speedup", 6).alias("best_speedup"))


@query("""WITH r AS (SELECT c_nationkey AS device, c_mktsegment AS config, avg(c_acctbal + 2000) AS mean FROM customer GROUP BY 1, 2),
c AS (SELECT n_nationkey AS device, config FROM nation, (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD', 'NONE']) AS config))
SELECT device, config, round(coalesce(CASE WHEN mean > 0 THEN max(CASE WHEN config = 'MACHINERY' THEN mean END) OVER (PARTITION BY device) / mean END, 0), 6) AS speedup FROM c LEFT JOIN r USING (device, config)""")
def baseline_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("device"), F.col("c_mktsegment").alias("config")).agg(F.avg(F.col("c_acctbal") + 2000).alias("value"))
    odd = F.col("device") % 2 == 1
    results = results.select("device", "config", F.when(odd, F.col("value")).alias("mean"), F.when(~odd, F.col("value")).alias("mean_ms"))
    configs = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("device"), F.explode(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD", "NONE")])).alias("config"))
    return benchmarks.speedups(configs, results, ["device", "config"], "MACHINERY").select("device", "config", F.round("speedup", 6).alias("speedup"))


@query("""WITH t AS (SELECT l_suppkey AS model, l_linenumber AS batch_size, sum(l_quantity) AS tp FROM lineitem GROUP BY 1, 2), o AS (SELECT model, tp AS one FROM t WHERE batch_size = 1 AND tp > 0)
SELECT model, batch_size, round(tp / (batch_size * one), 6) AS efficiency FROM t JOIN o USING (model)""")
def scaling_efficiencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("model"), F.col("l_linenumber").alias("batch_size")).agg(F.sum("l_quantity").alias("throughput"))
    return benchmarks.scaling_efficiency(own).select("model", "batch_size", F.round("efficiency", 6).alias("efficiency"))


@query("SELECT l_suppkey AS model, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS detections FROM lineitem GROUP BY 1")
def mean_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(benchmarks.whole_mean("l_linenumber").alias("detections"))


@query("""WITH d AS (SELECT s_suppkey AS device_id, CASE s_suppkey % 4 WHEN 0 THEN 'OrinNX' WHEN 1 THEN 'XavierNX' ELSE s_name END AS name FROM supplier) SELECT device_id, name, CASE WHEN contains(name, 'Xavier') OR contains(name, 'Orin') THEN 'jetson' ELSE 'rtx' END AS kind FROM d WHERE NOT contains(name, '7')""")
def device_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    own = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), F.when(k == 0, "OrinNX").when(k == 1, "XavierNX").otherwise(F.col("s_name")).alias("name"))
    return own.withColumn("kind", benchmarks.device_group(F.col("name"))).where(~F.col("name").contains("7"))


FRAMEWORKS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]


@query("""WITH m AS (SELECT c_nationkey AS device, c_mktsegment AS framework, CAST(floor(avg(c_acctbal)) AS BIGINT) AS a, CASE WHEN count(*) > 5 THEN CAST(floor(min(c_acctbal)) AS BIGINT) END AS b FROM customer GROUP BY 1, 2)
SELECT device, CAST(5 - list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'], framework) AS INT) AS place, framework || ',m,640,' || CAST(a AS VARCHAR) || '.0,N/A,' || coalesce(CAST(b AS VARCHAR) || '.0', 'N/A') || ',N/A' AS row FROM m""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("device"), F.col("c_mktsegment").alias("framework")).agg(F.floor(F.avg("c_acctbal")).alias("mean"), F.when(F.count("*") > 5, F.floor(F.min("c_acctbal"))).alias("min"))
    own = own.withColumns({"model": F.lit("m"), "size": F.lit(640), "median": F.lit(None).cast("double"), "max": F.lit(None).cast("double")})
    return benchmarks.report_rows(own, FRAMEWORKS).withColumn("place", F.col("place").cast("int"))


@query("SELECT p_partkey AS arg_id, 'in' || CAST(p_partkey AS VARCHAR) AS name, 3 AS n, p_size AS last FROM part")
def parsed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    arg = F.concat(F.lit("in"), F.col("p_partkey").cast("string"), F.lit(":1,,3,"), F.col("p_size").cast("string"), F.lit(","))
    own = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("arg_id"), scalars.parsed_shape(arg).alias("s"))
    return own.select("arg_id", "s.name", F.size("s.dims").alias("n"), F.element_at("s.dims", -1).alias("last"))


@query("""SELECT p_partkey AS model, CASE WHEN p_size % 9 = 0 OR p_size % 4 = 1 THEN 640 WHEN p_size % 2 = 0 THEN greatest(p_size * 20 // 32, 1) * 32 ELSE p_size * 20 END AS imgsz FROM part""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") % 9 != 0, F.col("p_size") * 20)
    divisor = F.when(F.col("p_size") % 2 == 0, 32)
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), scalars.image_size(size, F.lit(640), F.col("p_size") % 4 == 1, divisor).alias("imgsz"))


@query("""SELECT p_partkey AS model, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) || ',3,640,640' ELSE CAST(p_size AS VARCHAR) || ',2' END AS shape FROM part""")
def input_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "image").otherwise("size")
    shape = scalars.input_shape(kind, F.col("p_size"), F.lit(640))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), F.array_join(shape.cast("array<string>"), ",").alias("shape"))


@query("SELECT event_id, value * 1000 AS ms, value / 1000 AS unit, round(coalesce((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) * 100, 0), 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def converted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    change = F.coalesce(scalars.percent_difference(F.col("value"), before), F.lit(0.0))
    return views.table(spark, sf_dir, "events").select("event_id", scalars.seconds_to_ms(F.col("value")).alias("ms"), scalars.milli_to_unit(F.col("value")).alias("unit"), F.round(change, 6).alias("change"))


@query("SELECT s_suppkey AS engine, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 3 - 1 AS DOUBLE) / 10 END, 0.1) AS conf, coalesce(CASE WHEN s_suppkey % 5 = 0 THEN 'trt' END, 'cuda') AS preproc FROM supplier")
def engine_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each engine's own settings over the common ones; an explicit 0.0 counts."""
    own = F.when(F.col("s_suppkey") % 3 > 0, (F.col("s_suppkey") % 3 - 1).cast("double") / 10)
    return views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("engine"), scalars.override(own, F.lit(0.1)).alias("conf"), scalars.override(F.when(F.col("s_suppkey") % 5 == 0, "trt"), F.lit("cuda")).alias("preproc"))


@query("""SELECT p_partkey AS model, family, imgsz, input_range, resize, normalised, input_layout, output_layout, built_in_nms FROM part JOIN (SELECT *, row_number() OVER () - 1 AS n FROM (VALUES
('yolox', 640, '0:255', 'letterbox', FALSE, 'YOLO', 'EFFICIENT_NMS', TRUE),
('yolov3', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'EFFICIENT_NMS', TRUE),
('yolov5', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'EFFICIENT_NMS', TRUE),
('yolov7', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'EFFICIENT_NMS', FALSE),
('yolov8', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'EFFICIENT_NMS', TRUE),
('yolov9', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'EFFICIENT_NMS', FALSE),
('yolov10', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'YOLO_V10', FALSE),
('yolov11', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'EFFICIENT_NMS', TRUE),
('yolov12', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'EFFICIENT_NMS', TRUE),
('yolov13', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'EFFICIENT_NMS', TRUE),
('yolov26', 640, '0:1', 'letterbox', FALSE, 'YOLO', 'YOLO_V10', FALSE),
('deim', 640, '0:1', 'letterbox', TRUE, 'RT_DETR', 'DETR_LBS', FALSE),
('deimv2', 640, '0:1', 'letterbox', TRUE, 'RT_DETR', 'DETR_LBS', FALSE),
('rtdetrv1', 640, '0:255', 'linear', FALSE, 'RT_DETR', 'DETR_LBS', FALSE),
('rtdetrv2', 640, '0:255', 'linear', FALSE, 'RT_DETR', 'DETR_LBS', FALSE),
('rtdetrv3', 640, '0:255', 'linear', FALSE, 'RT_DETR_V3', 'RT_DETR_V3', FALSE),
('dfine', 640, '0:1', 'linear', TRUE, 'RT_DETR', 'DETR_LBS', FALSE),
('rfdetr', 576, '0:1', 'letterbox', TRUE, 'RF_DETR', 'RF_DETR', FALSE)
) AS t(family, imgsz, input_range, resize, normalised, input_layout, output_layout, built_in_nms)) f ON f.n = p_partkey % 18""")
def model_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets of models, each of which is of one family."""
    names = [r[0] for r in catalog.FAMILIES]
    models = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int")).alias("family"))
    return models.join(F.broadcast(catalog.model_families(spark)), "family")  # a row a family


@query("""SELECT p_partkey AS model, family, task, imgsz FROM part JOIN (SELECT *, row_number() OVER () - 1 AS n FROM (SELECT family, 'classification' AS task, CASE family WHEN 'inception' THEN 299 ELSE 224 END AS imgsz FROM (SELECT unnest([
'alexnet', 'convnext', 'densenet', 'efficientnet', 'efficientnetv2', 'googlenet', 'inception', 'maxvit', 'mnasnet', 'mobilenetv2', 'mobilenetv3',
'regnet', 'resnet', 'resnext', 'wideresnet', 'shufflenetv2', 'squeezenet', 'swintransformer', 'swintransformerv2', 'vgg', 'vit']) AS family)
UNION ALL SELECT 'depth_anything_v2', 'depth', 518)) f ON f.n = p_partkey % 22""")
def other_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets of classifiers and depth estimators."""
    names = [*catalog.CLASSIFIERS, "depth_anything_v2"]
    models = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int")).alias("family"))
    return models.join(F.broadcast(catalog.other_models(spark)), "family")  # a row a family


@query("""SELECT s_suppkey AS engine, 'conf=' || CASE WHEN s_suppkey % 2 = 0 THEN '0.3' ELSE '0.1' END || ',nms=0.5' || CASE WHEN s_suppkey % 3 = 0 THEN ',warmup=1' ELSE '' END AS settings,
CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' ELSE 'a' END AS hooks FROM supplier""")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides over defaults: single values replace, hooks are added."""
    even, third = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0
    base = F.create_map(F.lit("conf"), F.lit("0.1"), F.lit("nms"), F.lit("0.5"))
    conf = F.when(even, F.create_map(F.lit("conf"), F.lit("0.3"))).otherwise(F.create_map().cast("map<string,string>"))
    warm = F.when(third, F.create_map(F.lit("warmup"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    settings = catalog.merged_settings(catalog.merged_settings(base, conf), warm)
    hooks = catalog.appended(F.create_map(F.lit("hooks"), F.array(F.lit("a"))), F.when(even, F.create_map(F.lit("hooks"), F.array(F.lit("b")))).otherwise(F.create_map().cast("map<string,array<string>>")))
    pairs = F.array_sort(F.transform(F.map_entries(settings), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("engine"), F.array_join(pairs, ",").alias("settings"), F.array_join(hooks["hooks"], ",").alias("hooks"))


@query("""SELECT p_partkey AS model_id, p_name AS model, CASE WHEN contains(p_name, 'red') AND NOT contains(p_name, 'bolt') THEN 'torch' WHEN contains(p_name, 'red') THEN 'onnx' WHEN contains(p_name, 'ring') THEN 'paddle' END AS route FROM part""")
def model_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules on the name; the first that fits counts."""
    rules = [("red", "bolt", "torch"), ("red", None, "onnx"), ("ring", None, "paddle")]
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_name").alias("model"), catalog.routed(F.col("p_name"), rules).alias("route"))


@query(f"SELECT o_orderkey AS batch_id, CAST(k AS INT) AS place, round(CAST({catalog.uniform_sql('o_orderkey', 'k', 42)} AS FLOAT)::DOUBLE, 6) AS value FROM (SELECT o_orderkey, unnest(range(48)) AS k FROM orders)")
def synthetic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform random tensors from a seed, one for each order."""
    own = catalog.synthetic_batches(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id")), (1, 3, 4, 4), seed=42)
    return own.select("batch_id", F.posexplode("data").alias("place", "v")).select("batch_id", "place", F.round(F.col("v").cast("double"), 6).alias("value"))
