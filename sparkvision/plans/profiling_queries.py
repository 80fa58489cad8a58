"""Queries over latency, power and layer profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import profiling
from . import views
from .registry import query

METRIC = "round(avg({x}), 6) AS mean, round(median({x}), 6) AS median, min({x}) AS minimum, max({x}) AS maximum, round(coalesce(stddev_samp({x}), 0), 6) AS std, round(1.96 * coalesce(stddev_samp({x}), 0) / sqrt(count(*)), 6) AS ci95"
SIX = ("mean", "median", "std", "ci95")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"SELECT event_type AS series, user_id, {METRIC.format(x='value')} FROM events GROUP BY 1, 2")
def latency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), "user_id").agg(*profiling.metric("value"))
    return rounded(own, *SIX)


@query(f"SELECT event_type AS series, {METRIC.format(x='value')} FROM events GROUP BY 1 UNION ALL SELECT 'all', {METRIC.format(x='value')} FROM events")
def lockstep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several engines one after another give a result each; side by side they give a single one."""
    own = views.table(spark, sf_dir, "events").select(F.explode(F.array(F.col("event_type"), F.lit("all"))).alias("series"), "value")
    plain = [m for m, name in zip(profiling.metric("value"), profiling.METRIC, strict=True) if name != "median"]
    return rounded(own.groupBy("series").agg(*plain).join(profiling.exact_medians(own, ["series"], "value"), "series"), *SIX)


@query("""WITH m AS (SELECT event_type AS engine, user_id % 8 AS batch_size, avg(value) AS mean_s FROM events GROUP BY 1, 2)
SELECT engine, batch_size, round(mean_s * 1000, 6) AS mean_ms, round(CASE WHEN mean_s > 0 THEN batch_size / mean_s ELSE 0 END, 6) AS throughput FROM m""")
def throughputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("engine"), (F.col("user_id") % 8).alias("batch_size")).agg(F.avg("value").alias("mean_s"))
    return rounded(own.select("engine", "batch_size", (F.col("mean_s") * 1000).alias("mean_ms"), profiling.throughput(F.col("mean_s"), F.col("batch_size")).alias("throughput")), "mean_ms", "throughput")


#: Iterations of twice the length, so that a layer can occur twice in one.
PAIRED = views.SAMPLES + ", paired AS (SELECT run_id, iter // 2 AS iter, seq, layer, ms FROM samples), last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, iter, layer ORDER BY seq DESC) AS n FROM paired) WHERE n = 1)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).withColumn("iter", F.expr("iter div 2"))


@query(f"""WITH {PAIRED}, p AS (SELECT run_id, layer, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, min(ms) AS minimum, max(ms) AS maximum, count(*) AS n, min(seq) AS f FROM last_ GROUP BY 1, 2)
SELECT run_id, layer, mean, median, minimum, maximum, n, CAST(row_number() OVER (PARTITION BY run_id ORDER BY f) AS INT) AS place FROM p""")
def layer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.layer_profile(paired(spark, sf_dir)), "mean", "median")


TOTALS = PAIRED + ", numbered AS (SELECT run_id, ms, row_number() OVER (PARTITION BY run_id, layer ORDER BY iter) - 1 AS pos FROM last_), totals AS (SELECT run_id, pos, sum(ms) AS total FROM numbered GROUP BY 1, 2)"


@query(f"WITH {TOTALS} SELECT run_id, {METRIC.format(x='total')}, round(list_sort(list(round(total, 6)))[count(*) // 2 + 1], 6) AS upper_median FROM totals GROUP BY 1".replace("min(total)", "round(min(total), 6)").replace("max(total)", "round(max(total), 6)"))
def profile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = profiling.iteration_totals(paired(spark, sf_dir))
    own = totals.groupBy("run_id").agg(*profiling.metric("total"), profiling.upper_median("total").alias("upper_median"))
    return rounded(own, *SIX, "minimum", "maximum", "upper_median")


@query(f"WITH {views.SLICES} SELECT slice_id, ts, mw FROM slices JOIN power ON ts >= t0 AND ts <= t1")
def power_in_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.within(views.power(spark, sf_dir), views.slices(spark, sf_dir)).select("slice_id", "ts", "mw")


@query(f"WITH {views.SLICES} SELECT slice_id, round(avg(mw), 6) AS power, count(*) AS n, round(avg(mw) * (t1 - t0), 4) AS energy FROM slices JOIN power ON ts >= t0 AND ts <= t1 GROUP BY slice_id, t0, t1")
def energy_per_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = profiling.energy_per_slice(views.power(spark, sf_dir), views.slices(spark, sf_dir))
    return own.select("slice_id", F.round("power", 6).alias("power"), "n", F.round("energy", 4).alias("energy"))


@query(f"""WITH {views.SLICES}, l AS (SELECT layer, avg(ms) AS mean_ms FROM slices GROUP BY 1), p AS (SELECT layer, avg(mw) AS power FROM slices JOIN power ON ts >= t0 AND ts <= t1 GROUP BY 1)
SELECT layer, round(mean_ms, 6) AS mean_ms, round(coalesce(power, 0), 6) AS power, round(coalesce(power, 0) * mean_ms / 1000, 6) AS energy FROM l LEFT JOIN p USING (layer)""")
def layer_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.layer_power(views.power(spark, sf_dir), views.slices(spark, sf_dir)), "mean_ms", "power", "energy")


@query(f"""WITH {views.SAMPLES}, o AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY run_id, iter ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM samples)
SELECT run_id, iter, seq, layer, round(iter * 10 + b / 1000, 6) AS t0, round(iter * 10 + b / 1000 + ms / 1000, 6) AS t1 FROM o""")
def layer_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = profiling.layer_timeline(views.samples(spark, sf_dir).withColumn("start", F.col("iter") * 10))
    return rounded(own.select("run_id", "iter", "seq", "layer", "t0", "t1"), "t0", "t1")


#: Layer names of the shapes that compilers give.
NAMED = "named AS (SELECT user_id AS run_id, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN '/' || event_type || CASE WHEN event_id % 8 = 0 THEN '_myl' || CAST(event_id AS VARCHAR) || '_1' ELSE '' END ELSE event_type || CAST(event_id % 7 AS VARCHAR) END AS name, value AS ms FROM events)"
CHUNKS = NAMED + ", based AS (SELECT *, regexp_replace(name, '_myl\\d+_\\d+$', '') AS base FROM named), open_ AS (SELECT *, coalesce(last_value(CASE WHEN base LIKE '/%' THEN base END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '__prologue__') AS chunk FROM based), chunks AS (SELECT run_id, chunk, sum(ms) AS ms, CAST(row_number() OVER (PARTITION BY run_id ORDER BY min(pos)) AS INT) AS place FROM open_ GROUP BY 1, 2)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id").cast("string")
    anchor = F.concat(F.lit("/"), "event_type", F.when(F.col("event_id") % 8 == 0, F.concat(F.lit("_myl"), id_, F.lit("_1"))).otherwise(""))
    plain = F.concat("event_type", (F.col("event_id") % 7).cast("string"))
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 == 0, anchor).otherwise(plain).alias("name"), F.col("value").alias("ms"))


@query(f"WITH {CHUNKS} SELECT run_id, chunk, round(ms, 6) AS ms, place FROM chunks")
def chunk_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.chunk_map(named(spark, sf_dir)), "ms")


@query(f"""WITH {CHUNKS}, q AS (SELECT run_id, chunk, ms * (place % 3) / 2 AS quantised_ms FROM chunks)
SELECT run_id, chunk, place, round(CASE WHEN ms > 0 THEN (ms - quantised_ms) / ms * 100 ELSE 0 END, 6) AS speedup FROM chunks JOIN q USING (run_id, chunk)""")
def quantise_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = profiling.chunk_map(named(spark, sf_dir))
    other = base.withColumn("ms", F.col("ms") * (F.col("place") % 3) / 2)
    return rounded(profiling.quantise_speedup(base, other).select("run_id", "chunk", "place", "speedup"), "speedup")


#: Profiled names over a network's layers: pairs joined by +, ranges, single foreign nodes, suffixed names.
PROFILED = views.LAYERS + """, profiled AS (
  SELECT a.net, a.idx AS pos, CASE a.idx % 10 WHEN 0 THEN a.name || ' + ' || b.name WHEN 2 THEN '{ForeignNode[' || a.name || '...' || d.name || ']}' WHEN 5 THEN '{ForeignNode[' || a.name || ']}' WHEN 6 THEN a.name || '_myl3_4' WHEN 7 THEN 'x' || a.name ELSE 'other' || CAST(a.idx AS VARCHAR) END AS name, a.price AS value
  FROM layers a LEFT JOIN layers b ON b.net = a.net AND b.idx = a.idx + 1 LEFT JOIN layers d ON d.net = a.net AND d.idx = a.idx + 2
  WHERE a.idx % 10 NOT IN (1, 3, 4) AND (a.idx % 10 <> 0 OR b.name IS NOT NULL) AND (a.idx % 10 <> 2 OR d.name IS NOT NULL))"""
FUSED = PROFILED + """, cand AS (
  SELECT net, pos, unnest(string_split(name, ' + ')) AS layer, name AS fused, CAST(len(string_split(name, ' + ')) AS INT) AS n FROM profiled WHERE name NOT LIKE '{Foreign%' AND contains(name, ' + ')
  UNION ALL SELECT net, pos, regexp_extract(name, '\\[(.*)\\]', 1), name, 1 FROM profiled WHERE name LIKE '{Foreign%' AND NOT contains(name, '...')
  UNION ALL SELECT p.net, pos, l.name, p.name, CAST(b.idx - a.idx + 1 AS INT) FROM profiled p JOIN layers a ON a.net = p.net AND a.name = regexp_extract(p.name, '\\[(.*)\\.\\.\\.', 1) JOIN layers b ON b.net = p.net AND b.name = regexp_extract(p.name, '\\.\\.\\.(.*)\\]', 1) JOIN layers l ON l.net = p.net AND l.idx BETWEEN a.idx AND b.idx WHERE p.name LIKE '{Foreign%' AND contains(p.name, '...')
  UNION ALL SELECT p.net, pos, l.name, p.name, 1 FROM profiled p JOIN layers l ON l.net = p.net AND l.name = regexp_replace(p.name, '_myl\\d+_\\d+$', '') WHERE p.name NOT LIKE '{Foreign%' AND NOT contains(p.name, ' + ')),
fused AS (SELECT net, layer, fused, n FROM (SELECT *, row_number() OVER (PARTITION BY net, layer ORDER BY pos DESC, n DESC) AS r FROM cand) WHERE r = 1)"""


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("net", F.expr("idx div 10")).orderBy("idx")  # names that are joined stand in one ten
    own = views.layers(spark, sf_dir).withColumns({"b": F.lead("name").over(w), "d": F.lead("name", 2).over(w)})
    k = F.col("idx") % 10
    name = F.when(k == 0, F.concat("name", F.lit(" + "), "b")).when(k == 2, F.concat(F.lit("{ForeignNode["), "name", F.lit("..."), "d", F.lit("]}"))).when(k == 5, F.concat(F.lit("{ForeignNode["), "name", F.lit("]}"))).when(k == 6, F.concat("name", F.lit("_myl3_4"))).when(k == 7, F.concat(F.lit("x"), "name")).otherwise(F.concat(F.lit("other"), F.col("idx").cast("string")))
    return own.where(~k.isin(1, 3, 4)).select("net", F.col("idx").alias("pos"), name.alias("name"), F.col("price").alias("value")).where("name IS NOT NULL")


@query(f"WITH {FUSED} SELECT * FROM fused")
def fused_layer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.fused_layers(profiled(spark, sf_dir), views.layers(spark, sf_dir))


@query(f"""WITH {FUSED}, e AS (SELECT net, name AS layer, value FROM profiled), s AS (SELECT f.net, f.layer, value / n AS value FROM fused f JOIN profiled p ON p.net = f.net AND p.name = f.fused),
h AS (SELECT l.net, l.name AS layer, arg_min(p.value, p.pos) AS value FROM layers l JOIN profiled p ON p.net = l.net AND contains(p.name, l.name) GROUP BY 1, 2)
SELECT l.net, l.name AS layer, round(coalesce(e.value, s.value, h.value), 6) AS value FROM layers l LEFT JOIN e ON e.net = l.net AND e.layer = l.name LEFT JOIN s ON s.net = l.net AND s.layer = l.name LEFT JOIN h ON h.net = l.net AND h.layer = l.name""")
def resolved_layer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, net = profiled(spark, sf_dir), views.layers(spark, sf_dir)
    fused = profiling.fused_layers(values, net)
    return rounded(profiling.resolved(net.select("net", F.col("name").alias("layer")), values, fused), "value")


KINDS = ("FLOAT", "HALF", "INT8", "INT32", "BOOL", "UINT8", "INT64")


@query(f"""WITH {views.LAYERS}, s AS (SELECT net, idx, size, ['FLOAT', 'HALF', 'INT8', 'INT32', 'BOOL', 'UINT8', 'INT64'][key % 7 + 1] AS dtype FROM layers)
SELECT net, idx, dtype, greatest(1, size % 5 - 1) * 3 * size * CASE dtype WHEN 'HALF' THEN 2 WHEN 'INT8' THEN 1 WHEN 'BOOL' THEN 1 WHEN 'UINT8' THEN 1 ELSE 4 END AS bytes FROM s""")
def tensor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtype = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("key") % 7 + 1).cast("int"))
    shape = F.array((F.col("size") % 5 - 1).cast("int"), F.lit(3), F.col("size").cast("int"))
    return views.layers(spark, sf_dir).select("net", "idx", dtype.alias("dtype"), shape.alias("shape")).select("net", "idx", "dtype", profiling.tensor_bytes(F.col("shape"), F.col("dtype")).alias("bytes"))
