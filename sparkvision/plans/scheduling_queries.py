"""Queries over network layers: islands, placement, schedules, graph cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import profiling, scheduling, segments
from . import views
from .registry import query

ISLANDS = views.LAYERS + """, c AS (SELECT *, CASE WHEN compat <> lag(compat) OVER (PARTITION BY net ORDER BY idx) THEN 1 ELSE 0 END AS ch FROM layers),
g AS (SELECT *, sum(ch) OVER (PARTITION BY net ORDER BY idx) AS chunk FROM c), islands AS (SELECT net, CAST(chunk AS BIGINT) AS chunk, min(idx) AS first, max(idx) AS last, count(*) AS n, bool_and(compat) AS compat FROM g GROUP BY 1, 2)"""
CHOSEN = ISLANDS + ", chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY net ORDER BY n DESC, chunk) AS r FROM islands WHERE compat AND n >= 3) WHERE r <= 2)"


@query(f"WITH {ISLANDS} SELECT net, chunk, first, last, n, compat FROM islands")
def compatible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.islands(views.layers(spark, sf_dir))


@query(f"WITH {ISLANDS} SELECT net, bool_and(compat) AS runs_whole, count(*) AS chunks FROM islands GROUP BY 1")
def runs_whole_on_dla(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.islands(views.layers(spark, sf_dir)).groupBy("net").agg(F.bool_and("compat").alias("runs_whole"), F.count("*").alias("chunks"))


@query(f"WITH {CHOSEN} SELECT net, chunk, first, last, n, compat FROM chosen")
def selected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.selected(scheduling.islands(views.layers(spark, sf_dir)), 2, 3)


@query(f"""WITH {CHOSEN} SELECT l.net, l.idx, l.name, CASE WHEN c.net IS NOT NULL THEN 'INT8' WHEN type = 'SMALL' OR lower(name) LIKE '%tile%' THEN NULL ELSE 'HALF' END AS precision,
CASE WHEN c.net IS NOT NULL THEN 'DLA' ELSE 'GPU' END AS device FROM layers l LEFT JOIN chosen c ON c.net = l.net AND l.idx BETWEEN c.first AND c.last""")
def layer_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = views.layers(spark, sf_dir)
    chosen = scheduling.selected(scheduling.islands(layers), 2, 3)
    return scheduling.assigned(layers, chosen, ("SMALL",)).select("net", "idx", "name", "precision", "device")


@query(f"WITH {views.LAYERS} SELECT net, idx, round(CASE WHEN sum(price) OVER (PARTITION BY net) > 0 THEN 5000 * price / sum(price) OVER (PARTITION BY net) ELSE 0 END, 6) AS energy FROM layers")
def energy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scheduling.energy_shares(views.layers(spark, sf_dir).withColumn("mean", F.col("price")), F.lit(5000.0))
    return own.select("net", "idx", F.round("energy", 6).alias("energy"))


#: Measured costs with gaps: some layers not measured, blobs of four layers, single layers with a cost of their own.
COSTED = views.LAYERS + """, costed AS (SELECT net, idx, size, compat, CASE WHEN key % 13 <> 0 THEN price / 1000 END AS gpu_time, CASE WHEN key % 17 <> 0 THEN price / 100 END AS gpu_energy, CASE WHEN idx % 8 < 4 THEN 'blob' || CAST(idx // 8 AS VARCHAR) END AS blob,
  CASE WHEN idx % 8 < 4 THEN 4.0::DOUBLE END AS blob_time, CASE WHEN idx % 8 < 4 THEN 20.0::DOUBLE END AS blob_energy, CASE WHEN key % 19 = 0 THEN 2.5::DOUBLE END AS exact_time, CASE WHEN key % 19 = 0 THEN 6.5::DOUBLE END AS exact_energy FROM layers),
gpu AS (SELECT *, coalesce(gpu_time, 0.01) AS gpu_ms, coalesce(gpu_energy, 0.001) AS gpu_mj FROM costed),
costs AS (SELECT net, idx, size * 40000 AS size, compat, gpu_ms, gpu_mj, coalesce(exact_time, CASE WHEN blob IS NOT NULL THEN blob_time * gpu_ms / sum(gpu_ms) OVER w END, gpu_ms * 1.5) AS dla_ms, coalesce(exact_energy, CASE WHEN blob IS NOT NULL THEN blob_energy * gpu_mj / sum(gpu_mj) OVER w END, gpu_mj * 0.5) AS dla_mj FROM gpu WINDOW w AS (PARTITION BY net, blob))"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_blob = F.col("idx") % 8 < 4
    odd = F.col("key") % 19 == 0
    own = views.layers(spark, sf_dir).select(
        "net", "idx", (F.col("size") * 40000).alias("size"), "compat",
        F.when(F.col("key") % 13 != 0, F.col("price") / 1000).alias("gpu_time"), F.when(F.col("key") % 17 != 0, F.col("price") / 100).alias("gpu_energy"),
        F.when(in_blob, F.concat(F.lit("blob"), F.expr("CAST(idx div 8 AS STRING)"))).alias("blob"),
        F.when(in_blob, 4.0).alias("blob_time"), F.when(in_blob, 20.0).alias("blob_energy"), F.when(odd, 2.5).alias("exact_time"), F.when(odd, 6.5).alias("exact_energy"),
    )
    return scheduling.dla_costs(own)


@query(f"WITH {COSTED} SELECT net, idx, round(gpu_ms, 6) AS gpu_ms, round(gpu_mj, 6) AS gpu_mj, round(dla_ms, 6) AS dla_ms, round(dla_mj, 6) AS dla_mj FROM costs")
def blob_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs(spark, sf_dir).select("net", "idx", *[F.round(c, 6).alias(c) for c in ("gpu_ms", "gpu_mj", "dla_ms", "dla_mj")])


@query(f"""WITH {COSTED}, a AS (SELECT net || '-' || CAST(k AS VARCHAR) AS schedule_id, idx, CASE WHEN idx // k % 2 = 1 THEN 'D' ELSE 'G' END AS proc, size, gpu_ms, gpu_mj, dla_ms, dla_mj FROM costs, (SELECT unnest([3, 10, 100000]) AS k)),
l AS (SELECT *, coalesce(lag(proc) OVER w <> proc, FALSE) AS ch, lag(size) OVER w / 1048576.0 AS mb FROM a WINDOW w AS (PARTITION BY schedule_id ORDER BY idx))
SELECT schedule_id, round(sum(CASE WHEN proc = 'D' THEN dla_ms ELSE gpu_ms END + CASE WHEN ch THEN 0.1 + mb * 0.05 ELSE 0 END), 6) AS time_ms, round(sum(CASE WHEN proc = 'D' THEN dla_mj ELSE gpu_mj END + CASE WHEN ch THEN 0.01 + mb * 0.005 ELSE 0 END), 6) AS energy_mj, CAST(sum(CAST(ch AS INT)) AS BIGINT) AS transitions FROM l GROUP BY 1""")
def schedule_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = costs(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(3), F.lit(10), F.lit(100000))))
    own = own.withColumn("schedule_id", F.concat("net", F.lit("-"), F.col("k").cast("string"))).withColumn("proc", F.when(F.expr("idx div k") % 2 == 1, "D").otherwise("G"))
    return scheduling.schedule_cost(own).select("schedule_id", F.round("time_ms", 6).alias("time_ms"), F.round("energy_mj", 6).alias("energy_mj"), "transitions")


SOLVED = COSTED + """, s AS (SELECT *, size / 1048576.0 AS mb, CAST(NOT compat AS INT) AS bad, count(*) OVER (PARTITION BY net) AS n FROM costs),
cand AS (SELECT a.net, a.idx + 1 AS cut, p.first_proc,
    sum(CASE WHEN (b.idx <= a.idx) = (p.first_proc = 'G') THEN b.gpu_ms ELSE b.dla_ms END) + max(CASE WHEN a.idx + 1 < a.n THEN 0.1 + a.mb * 0.05 ELSE 0 END) AS t,
    sum(CASE WHEN (b.idx <= a.idx) = (p.first_proc = 'G') THEN b.gpu_mj ELSE b.dla_mj END) + max(CASE WHEN a.idx + 1 < a.n THEN 0.01 + a.mb * 0.005 ELSE 0 END) AS e,
    sum(CASE WHEN (b.idx <= a.idx) = (p.first_proc = 'G') THEN 0 ELSE b.bad END) AS bad, sum(b.gpu_mj) AS all_mj
  FROM s a JOIN s b ON b.net = a.net, (SELECT unnest(['G', 'D']) AS first_proc) p GROUP BY 1, 2, 3),
good AS (SELECT *, row_number() OVER (PARTITION BY net ORDER BY round(t, 9), round(e, 9), cut, first_proc) AS r FROM cand WHERE bad = 0 AND round(e, 9) <= round(0.8 * all_mj, 9))"""


@query(f"""WITH {SOLVED}, plain AS (SELECT net, sum(gpu_ms) AS t, sum(gpu_mj) AS e, count(*) AS n FROM costs GROUP BY 1)
SELECT p.net, CAST(coalesce(g.cut, p.n) AS INT) AS cut, coalesce(first_proc, 'G') AS first_proc, round(coalesce(g.t, p.t), 6) AS time_ms, round(coalesce(g.e, p.e), 6) AS energy_mj FROM plain p LEFT JOIN good g ON g.net = p.net AND g.r = 1""")
def solved_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = costs(spark, sf_dir)
    return scheduling.solved_one_change(own).select("net", F.col("cut").cast("int").alias("cut"), "first_proc", F.round("time_ms", 6).alias("time_ms"), F.round("energy_mj", 6).alias("energy_mj"))


@query(f"""WITH {SOLVED}, plain AS (SELECT net, sum(gpu_ms) AS t, sum(gpu_mj) AS e FROM costs GROUP BY 1)
SELECT p.net, round(coalesce(g.t, p.t), 6) AS time_ms, round(coalesce(g.e, p.e), 6) AS energy_mj FROM plain p LEFT JOIN good g ON g.net = p.net AND g.r = 1""")
def solved_schedules_one_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier solver with one change must find what the prefix sums find."""
    return scheduling.solved(costs(spark, sf_dir), max_transitions=1).select("net", F.round("time_ms", 6).alias("time_ms"), F.round("energy_mj", 6).alias("energy_mj"))


#: Sums over a network's first i layers, and what a change before layer i costs (nothing behind the last).
FIRST_LAYERS = COSTED + """, s AS (SELECT net, idx + 1 AS i, sum(gpu_ms) OVER w AS gt, sum(gpu_mj) OVER w AS ge, sum(dla_ms) OVER w AS dt, sum(dla_mj) OVER w AS de, sum(CAST(NOT compat AS INT)) OVER w AS bad, size / 1048576.0 AS mb, count(*) OVER (PARTITION BY net) AS n FROM costs WINDOW w AS (PARTITION BY net ORDER BY idx)),
cuts AS (SELECT net, i, n, gt, ge, dt, de, bad, CASE WHEN i < n THEN 0.1 + mb * 0.05 ELSE 0 END AS ct, CASE WHEN i < n THEN 0.01 + mb * 0.005 ELSE 0 END AS ce FROM s),
cand AS (SELECT a.net, w.ge AS all_mj,
    CASE WHEN p.g THEN a.gt + b.dt - a.dt + c.gt - b.gt + w.dt - c.dt ELSE a.dt + b.gt - a.gt + c.dt - b.dt + w.gt - c.gt END + a.ct + b.ct + c.ct AS t,
    CASE WHEN p.g THEN a.ge + b.de - a.de + c.ge - b.ge + w.de - c.de ELSE a.de + b.ge - a.ge + c.de - b.de + w.ge - c.ge END + a.ce + b.ce + c.ce AS e,
    CASE WHEN p.g THEN b.bad - a.bad + w.bad - c.bad ELSE a.bad + c.bad - b.bad END AS bad
  FROM cuts a JOIN cuts b ON b.net = a.net AND (b.i > a.i OR a.i = a.n AND b.i = b.n) JOIN cuts c ON c.net = a.net AND (c.i > b.i OR b.i = b.n AND c.i = c.n) JOIN cuts w ON w.net = a.net AND w.i = w.n, (SELECT unnest([TRUE, FALSE]) AS g) p),
good AS (SELECT net, min({'t': round(t, 9), 'e': round(e, 9)}) AS b FROM cand WHERE bad = 0 AND e <= 0.8 * all_mj + 1e-9 GROUP BY 1)"""


@query(f"""WITH {FIRST_LAYERS}, plain AS (SELECT net, sum(gpu_ms) AS t, sum(gpu_mj) AS e FROM costs GROUP BY 1)
SELECT p.net, round(coalesce(g.b.t, p.t), 6) AS time_ms, round(coalesce(g.b.e, p.e), 6) AS energy_mj FROM plain p LEFT JOIN good g USING (net)""")
def solved_schedules_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three changes of processor."""
    own = segments.solved_in_rounds(costs(spark, sf_dir), max_transitions=3)
    return own.select("net", F.round("time_ms", 6).alias("time_ms"), F.round("energy_mj", 6).alias("energy_mj"))


@query(f"""WITH {SOLVED}, gpu_only AS (SELECT net, round(sum(gpu_ms), 9) AS t, round(sum(gpu_mj), 9) AS e FROM costs GROUP BY 1), best AS (SELECT p.net, coalesce(round(g.t, 9), p.t) AS t, coalesce(round(g.e, 9), p.e) AS e FROM gpu_only p LEFT JOIN good g ON g.net = p.net AND g.r = 1),
moved AS (SELECT *, coalesce(lag(compat) OVER w <> compat, FALSE) AS ch, lag(size) OVER w / 1048576.0 AS mb FROM costs WINDOW w AS (PARTITION BY net ORDER BY idx)),
dla_first AS (SELECT net, round(sum(CASE WHEN compat THEN dla_ms ELSE gpu_ms END + CASE WHEN ch THEN 0.1 + mb * 0.05 ELSE 0 END), 9) AS t, round(sum(CASE WHEN compat THEN dla_mj ELSE gpu_mj END + CASE WHEN ch THEN 0.01 + mb * 0.005 ELSE 0 END), 9) AS e FROM moved GROUP BY 1)
SELECT net, round(b.t, 6) AS time_ms, round(b.e, 6) AS energy_mj, round(1000 / b.t, 4) AS fps, round(b.e / b.t, 4) AS watts, round((b.t - p.t) / p.t * 100, 4) AS time_vs_gpu, round((b.e - p.e) / p.e * 100, 4) AS energy_vs_gpu, round((b.t - d.t) / d.t * 100, 4) AS time_vs_dla, round((b.e - d.e) / d.e * 100, 4) AS energy_vs_dla
FROM best b JOIN gpu_only p USING (net) JOIN dla_first d USING (net)""")
def schedule_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solved schedules beside all-GPU and DLA-where-possible."""
    own = costs(spark, sf_dir)
    found = scheduling.compared_schedules(scheduling.solved_one_change(own), own)
    exact = [F.round(c, 6).alias(c) for c in ("time_ms", "energy_mj")]
    return found.select("net", *exact, *[F.round(c, 4).alias(c) for c in ("fps", "watts", "time_vs_gpu", "energy_vs_gpu", "time_vs_dla", "energy_vs_dla")])


#: A network as tensors: each layer consumes its predecessor's tensor and, every third, that of two before.
IO = views.LAYERS + """, io AS (SELECT net, idx AS node, 't' || CAST(idx AS VARCHAR) AS tensor, 'out' AS dir FROM layers UNION ALL SELECT net, idx, 't' || CAST(idx - 1 AS VARCHAR), 'in' FROM layers UNION ALL SELECT net, idx, 't' || CAST(idx - 3 AS VARCHAR), 'in' FROM layers WHERE idx % 3 = 0)"""


def io(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.layers(spark, sf_dir)
    name = lambda d: F.concat(F.lit("t"), (F.col("idx") - d).cast("string")).alias("tensor")
    ports = [own.select("net", F.col("idx").alias("node"), name(0), F.lit("out").alias("dir")), own.select("net", F.col("idx").alias("node"), name(1), F.lit("in").alias("dir")), own.where("idx % 3 = 0").select("net", F.col("idx").alias("node"), name(3), F.lit("in").alias("dir"))]
    return ports[0].union(ports[1]).union(ports[2])


@query(f"""WITH {IO}, used AS (SELECT DISTINCT net, tensor FROM io WHERE node BETWEEN 4 AND 12 AND dir = 'in'), made AS (SELECT DISTINCT net, tensor FROM io WHERE node BETWEEN 4 AND 12 AND dir = 'out'),
later AS (SELECT m.*, EXISTS (SELECT 1 FROM io i WHERE i.net = m.net AND i.tensor = m.tensor AND i.node > 12 AND i.dir = 'in') AS l FROM made m)
SELECT net, tensor, 'input' AS port FROM used ANTI JOIN made USING (net, tensor) UNION ALL SELECT net, tensor, 'output' FROM (SELECT *, bool_or(l) OVER (PARTITION BY net) AS any_ FROM later) WHERE l OR NOT any_""")
def subgraph_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.subgraph_ports(io(spark, sf_dir), 4, 12)


@query(f"""WITH {views.LAYERS}, ends AS (SELECT net, idx FROM layers WHERE size = 50 AND idx < (SELECT max(idx) FROM layers l2 WHERE l2.net = layers.net) UNION SELECT net, max(idx) FROM layers GROUP BY 1)
SELECT net, CAST(row_number() OVER w - 1 AS INT) AS part, CAST(coalesce(lag(idx) OVER w, -1) + 1 AS INT) AS first, idx AS last FROM ends WINDOW w AS (PARTITION BY net ORDER BY idx)""")
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.layers(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("net"))
    sizes = own.groupBy("net").agg(F.count("*").cast("int").alias("n"))
    cuts = own.withColumn("n", n).where("size = 50 AND idx < n - 1").select("net", "idx")
    return scheduling.split_ranges(cuts, sizes).select("net", "part", "first", F.col("last").cast("int").alias("last"))


@query(f"""WITH {IO}, ends AS (SELECT net, idx FROM layers WHERE size = 50 AND idx < (SELECT max(idx) FROM layers l2 WHERE l2.net = layers.net) UNION SELECT net, max(idx) FROM layers GROUP BY 1),
parts AS (SELECT net, CAST(row_number() OVER w - 1 AS INT) AS part, coalesce(lag(idx) OVER w, -1) + 1 AS first, idx AS last FROM ends WINDOW w AS (PARTITION BY net ORDER BY idx)),
placed AS (SELECT io.*, part, last FROM io JOIN parts p ON p.net = io.net AND node BETWEEN first AND last),
used AS (SELECT DISTINCT net, part, tensor FROM placed WHERE dir = 'in'), made AS (SELECT DISTINCT net, part, last, tensor FROM placed WHERE dir = 'out'),
later AS (SELECT m.*, EXISTS (SELECT 1 FROM io i WHERE i.net = m.net AND i.tensor = m.tensor AND i.node > m.last AND i.dir = 'in') AS l FROM made m)
SELECT net, part, tensor, 'input' AS port FROM used ANTI JOIN made USING (net, part, tensor) UNION ALL SELECT net, part, tensor, 'output' FROM (SELECT *, bool_or(l) OVER (PARTITION BY net, part) AS any_ FROM later) WHERE l OR NOT any_""")
def split_subgraph_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ports of every part of every split network."""
    return scheduling.split_ports(io(spark, sf_dir), split_ranges(spark, sf_dir))


@query(f"""WITH {ISLANDS.replace("FROM part)", "FROM part WHERE p_size > 48)")}, nets AS (SELECT DISTINCT p_brand AS net FROM part)
SELECT net, coalesce(chunk, 0) AS chunk, coalesce(first, 0) AS first, coalesce(last, -1) AS last, coalesce(n, 0) AS n, coalesce(compat, FALSE) AS compat FROM nets LEFT JOIN islands USING (net)""")
def compatible_chunks_of_large_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of their large layers only; some have none."""
    own = views.layers(spark, sf_dir)
    w = Window.partitionBy("net").orderBy("key")
    large = own.where("size > 48").withColumn("idx", F.row_number().over(w) - 1)
    return scheduling.islands(large, own)


@query("SELECT p_partkey AS engine, [CASE WHEN p_size % 3 - 1 > 0 THEN p_size % 3 - 1 ELSE 1 END, 3, CASE WHEN p_size - 10 > 0 THEN p_size - 10 ELSE 1 END][3] AS width, CASE WHEN p_size % 3 - 1 > 0 THEN p_size % 3 - 1 ELSE 1 END AS batch FROM part")
def static_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = scheduling.static_shape(F.array((F.col("p_size") % 3 - 1).cast("int"), F.lit(3), (F.col("p_size") - 10).cast("int")))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("engine"), shape.alias("s")).select("engine", F.col("s")[2].alias("width"), F.col("s")[0].alias("batch"))


@query("""WITH n AS (SELECT p_partkey AS layer, p_name || CASE p_partkey % 5 WHEN 0 THEN '/ReduceMean' WHEN 1 THEN '/downSample.2' ELSE '' END AS name FROM part) SELECT layer, name, contains(lower(name), 'reducemean') OR contains(lower(name), 'downsample') AS in_float FROM n""")
def precision_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(k == 0, "/ReduceMean").when(k == 1, "/downSample.2").otherwise(""))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("layer"), name.alias("name")).withColumn("in_float", scheduling.kept_in_float(F.col("name")))


@query("""SELECT p_partkey AS build, p_size % 2 = 1 AND NOT p_size % 3 = 1 AND NOT p_size % 5 = 1 AS fp16, p_size % 3 = 1 AND NOT p_size % 5 = 1 AS int8, p_size % 5 = 1 AS fp8 FROM part""")
def consistent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.table(spark, sf_dir, "part").selectExpr("p_partkey AS build", "p_size % 2 = 1 AS fp16", "p_size % 3 = 1 AS int8", "p_size % 5 = 1 AS fp8")
    return scheduling.consistent_flags(own)


@query(f"""WITH {ISLANDS} SELECT l.net, l.idx, l.name, greatest(1, l.size % 5 - 1) * 3 * 4 + l.size * 4 AS tensor_size, i.compat AS on_island FROM layers l JOIN islands i ON i.net = l.net AND l.idx BETWEEN i.first AND i.last""")
def inspected_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a layer's input and output tensors, and whether it stands on a compatible island."""
    own = views.layers(spark, sf_dir)
    ins = profiling.tensor_bytes(F.array((F.col("size") % 5 - 1).cast("int"), F.lit(3)), F.lit("FLOAT"))
    outs = profiling.tensor_bytes(F.array(F.col("size").cast("int")), F.lit("INT64"))
    spans = scheduling.islands(own).select("net", "first", "last", F.col("compat").alias("on_island"))
    sized = own.withColumn("tensor_size", ins + outs)
    return sized.join(spans, "net").where("idx BETWEEN first AND last").select("net", "idx", "name", "tensor_size", "on_island")


@query(f"""WITH {views.LAYERS}, p AS (SELECT net, idx, name, idx % 3 <> 2 AS is_input FROM layers)
SELECT net, array_to_string(list(name ORDER BY idx) FILTER (is_input), ',') AS inputs, array_to_string(list(name ORDER BY idx) FILTER (NOT is_input), ',') AS outputs FROM p GROUP BY 1""")
def engine_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input and output names of each engine in their order."""
    port = F.struct("idx", "name")
    own = views.layers(spark, sf_dir).groupBy("net").agg(F.array_sort(F.collect_list(F.when(F.col("idx") % 3 != 2, port))).alias("i"), F.array_sort(F.collect_list(F.when(F.col("idx") % 3 == 2, port))).alias("o"))
    return own.select("net", F.array_join("i.name", ",").alias("inputs"), F.array_join("o.name", ",").alias("outputs"))


@query("""WITH o AS (SELECT p_partkey AS engine, p_size % 8 - 1 AS level, ['gpu', 'DLA', 'cpu', 'GPU'][p_partkey % 4 + 1] AS device, p_size % 3 = 0 AS fp16, p_size % 5 = 0 AS int8, p_size % 7 = 0 AS calibrated, p_size % 11 = 0 AS format, p_size % 2 = 0 AS known FROM part)
SELECT engine, concat_ws(',', CASE WHEN level NOT BETWEEN 0 AND 5 THEN 'optimisation_level' END, CASE WHEN device = 'cpu' THEN 'device' END, CASE WHEN format AND NOT known THEN 'input_formats' END) AS broken,
CASE WHEN int8 AND NOT calibrated THEN 'int8_without_calibration' ELSE '' END AS doubtful, lower(device) AS device, fp16 OR int8 AS fp16, int8, format AS direct_io FROM o""")
def build_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that build options break, and what follows from them."""
    k, part = F.col("p_size"), views.table(spark, sf_dir, "part")
    device = F.element_at(F.array(*map(F.lit, ("gpu", "DLA", "cpu", "GPU"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    own = part.select(
        F.col("p_partkey").alias("engine"), (k % 8 - 1).alias("optimisation_level"), device.alias("device"), (k % 3 == 0).alias("fp16"), F.lit(None).cast("boolean").alias("fp8"),
        (k % 5 == 0).alias("int8"), F.lit(None).cast("boolean").alias("direct_io"), F.when(k % 11 == 0, F.array(F.when(k % 2 == 0, "images").otherwise("pixels"))).alias("input_formats"),
        F.lit(None).cast("array<string>").alias("output_formats"), F.array(F.lit("images")).alias("inputs"), F.array(F.lit("boxes")).alias("outputs"), (k % 7 == 0).alias("has_calibration"),
    )
    return scheduling.build_options(own).select("engine", F.array_join("broken", ",").alias("broken"), F.array_join("doubtful", ",").alias("doubtful"), "device", "fp16", "int8", "direct_io")


@query("SELECT s_suppkey AS engine, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey WHEN s_suppkey % 2 = 0 THEN 10000 ELSE 100 END AS BIGINT) AS iterations FROM supplier")
def profile_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterations of a profiling run: asked for, or the default of its kind of device."""
    n = profiling.profile_iterations(F.col("s_suppkey") % 2 == 0, F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")))
    return views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("engine"), n.cast("long").alias("iterations"))
