"""Vectors worked by hand."""

import itertools
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvision.functions import scalars
from sparkvision.operators import benchmarks, classification, detection, hulls, image, profiling, scheduling, segments
from sparkvision.operators.names import first_containing

DET = "image_id int, det_id int, class_id int, score double, x1 double, y1 double, x2 double, y2 double"


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_metric(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in range(1, 6)] + [(2, 42.0), (3, 1.0), (3, 2.0), (3, 3.0), (3, 4.0)], "s int, x double")
    got = {r.s: r for r in rows.groupBy("s").agg(*profiling.metric("x"), profiling.upper_median("x").alias("upper")).collect()}
    assert (got[1]["mean"], got[1]["median"]) == (3, 3)
    assert got[1]["std"] == pytest.approx(1.5811388300841898) and got[1]["ci95"] == pytest.approx(1.3859292911256331)
    assert (got[2]["std"], got[2]["ci95"]) == (0, 0)
    assert (got[3]["median"], got[3]["upper"]) == (2.5, 3)


def test_softmax_and_ties(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 2.0), (2, 0, 5.0), (2, 1, 5.0)], "image_id int, class_idx int, x double")
    probs = {(r.image_id, r.class_idx): r.prob for r in classification.softmax(rows).collect()}
    assert [round(probs[1, k], 6) for k in range(3)] == [0.090031, 0.665241, 0.244728]
    assert values(classification.top_k(classification.softmax(rows), 1).where("image_id = 2"), "class_idx") == [(1,)]


def test_depth(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 6.0), (2, 3.0), (2, 3.0)], "image_id int, x double")
    got = sorted(values(classification.depth_normalised(rows).withColumn("depth", F.round("depth", 6)), "image_id", "x", "depth"))
    assert got == [(1, 2.0, 0.0), (1, 4.0, 0.5), (1, 6.0, 1.0), (2, 3.0, 0.0), (2, 3.0, 0.0)]


@pytest.mark.parametrize(("w", "h", "expected"), [(1920, 1080, (640, 360, 0, 140)), (500, 333, (640, 426, 0, 107))])
def test_letterbox(spark, w, h, expected):
    rows = spark.createDataFrame([(1, w, h)], "image_id int, w int, h int")
    assert values(image.letterbox_geometry(rows), "new_w", "new_h", "pad_x", "pad_y") == [expected]


def test_resample_row(spark):
    pixels = spark.createDataFrame([(1, 0, x, c, 100 * x) for x in range(2) for c in range(3)], "image_id int, y int, x int, c int, value int")
    geometry = image.linear_geometry(spark.createDataFrame([(1, 2, 1)], "image_id int, w int, h int"), 4, 1)
    got = sorted(values(image.resampled(pixels, geometry, 4, 1).where("c = 0"), "x", "value"))
    assert [v for _, v in got] == [0, 25, 75, 100]


def test_normalise(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 2, 128)], "image_id int, y int, x int, c int, value int")
    assert values(image.normalised(pixels, 1, 1), "idx")[0] == (0,)
    assert values(image.normalised(pixels, 1, 1), "value")[0][0] == pytest.approx((128 / 255 - 0.485) / 0.229)
    with pytest.raises(ValueError):
        image.normalised(pixels, 1, 1, std=None)
    with pytest.raises(ValueError):
        image.preprocessed(pixels, pixels, 1, 1, "cubic")


def test_decode_clips_at_zero_only(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0.5, -5.0, 140.0, 320.0, 500.0), (1, 2, 0, float("nan"), 0.0, 0.0, 1.0, 1.0)], DET)
    rows = rows.withColumns({"ratio_x": F.lit(1.0) / 3, "ratio_y": F.lit(1.0) / 3, "pad_x": F.lit(0), "pad_y": F.lit(140)})
    got = values(detection.decode_end_to_end(rows, 0.1), *detection.BOX)
    assert [tuple(round(v, 6) for v in r) for r in got] == [(0, 0, 960, 1080)]
    assert detection.confident(rows, None).count() == 2 and detection.confident(rows, 0.0).count() == 1


def test_query_logits(spark):
    x = [[0.0, 2.0, -1.0], [1.0, -3.0, 0.5]]
    logits = spark.createDataFrame([(1, q, c, x[q][c]) for q in range(2) for c in range(3)], "image_id int, query int, class_slot int, x double")
    boxes = spark.createDataFrame([(1, q, 0.5, 0.5, 0.2, 0.2, 1.0, 1.0, 0, 0) for q in range(2)], "image_id int, query int, cx double, cy double, bw double, bh double, ratio_x double, ratio_y double, pad_x int, pad_y int")
    got = values(detection.decode_query_logits(logits, boxes, 3).orderBy("rank"), "query", "class_id", "score", "x1")
    assert [(q, c, round(s, 6), round(a, 3)) for q, c, s, a in got] == [(0, 0, 0.880797, 256.0), (1, -1, 0.731059, 256.0)]


def test_concatenated(spark):
    rows = spark.createDataFrame([(0, p, 0.0, 0.0, 1.0, 1.0, 0.9, 0) for p in range(5)], "batch_id int, pos int, x1 double, y1 double, x2 double, y2 double, score double, class_id int")
    counts = spark.createDataFrame([(0, 0, 2), (0, 1, 0), (0, 2, 3)], "batch_id int, image_id int, n int")
    assert sorted(values(detection.decode_concatenated(rows, counts), "image_id", "pos")) == [(0, 0), (0, 1), (2, 2), (2, 3), (2, 4)]


def test_final_detections_truncate(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0.5, 1.9, 2.2, 0.0, 9.99), (1, 2, 0, 0.4, 0.0, 0.0, 1.0, 1.0)], DET)
    assert values(detection.as_integers(rows, 0.5), *detection.BOX) == [(1, 2, 0, 9)]


def test_nms_keeps_what_a_suppressed_box_hides(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.8, 0.0, 0.0, 10.0, 8.0), (1, 3, 0, 0.7, 0.0, 0.0, 10.0, 5.0), (1, 4, 1, 0.6, 0.0, 0.0, 10.0, 10.0)], DET)
    assert sorted(values(detection.nms(rows), "det_id")) == [(1,), (3,), (4,)]
    assert sorted(values(detection.nms(rows, agnostic=True), "det_id")) == [(1,), (3,)]
    assert detection.nms(rows.limit(0)).count() == 0
    assert detection.nms(rows, top_k=1).count() == 1


def test_layouts(spark):
    cases = [(["num", "boxes", "scores", "classes"], "EFFICIENT_NMS"), (["labels", "boxes", "scores"], "DETR_LBS"), (["x", "scale"], "RT_DETR_V3"), (["x", "y"], "RF_DETR"), (["a"] * 5, None)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "n array<string>")
    assert [r[0] for r in rows.select(detection.output_layout(F.col("n"))).collect()] == [c[1] for c in cases]
    ins = spark.createDataFrame([(["input"],), (["im_shape", "image", "scale_factor"],), (["p", "q"],), (["q"] * 4,)], "n array<string>")
    assert [r[0] for r in ins.select(detection.input_layout(F.col("n"))).collect()] == ["RF_DETR", "RT_DETR_V3", "RT_DETR", None]


def test_chunk_map(spark):
    rows = [(1, i, n, float(m)) for i, (n, m) in enumerate([("a", 1), ("/x_myl0_1", 2), ("b", 3), ("/y", 4), ("/x_myl0_7", 5)])]
    got = values(profiling.chunk_map(spark.createDataFrame(rows, "run_id int, pos int, name string, ms double")).orderBy("place"), "chunk", "ms")
    assert got == [("__prologue__", 1.0), ("/x", 10.0), ("/y", 4.0)]


def test_fusion(spark):
    prof = spark.createDataFrame([("n", 0, "p + q", 6.0), ("n", 1, "{ForeignNode[b...d]}", 9.0), ("n", 2, "/m_myl0_4", 1.0), ("n", 3, "xxrzz", 9.0)], "net string, pos int, name string, value double")
    net = spark.createDataFrame([("n", i, x) for i, x in enumerate(["a", "b", "c", "d", "e", "/m"])], "net string, idx int, name string")
    fused = profiling.fused_layers(prof, net)
    assert sorted(values(fused, "layer", "n")) == [("/m", 1), ("b", 3), ("c", 3), ("d", 3), ("p", 2), ("q", 2)]
    want = spark.createDataFrame([("n", x) for x in ("p", "r", "nope", "c")], "net string, layer string")
    assert {r.layer: r.value for r in profiling.resolved(want, prof, fused).collect()} == {"p": 3.0, "r": 9.0, "nope": None, "c": 3.0}


def test_speedup(spark):
    a = spark.createDataFrame([(1, "x", 10.0, 1), (1, "y", 0.0, 2)], "run_id int, chunk string, ms double, place int")
    b = spark.createDataFrame([(1, "x", 4.0, 1), (1, "z", 4.0, 2)], "run_id int, chunk string, ms double, place int")
    assert values(profiling.quantise_speedup(a, b), "speedup") == [(60.0,)]
    with pytest.raises(Exception, match="without counterpart"):
        profiling.quantise_speedup(a, b, strict=True).collect()


def test_interval_join_includes_both_ends(spark):
    slices = spark.createDataFrame([(1, 0.0, 600.0), (2, 599.0, 1300.0), (3, 5000.0, 5001.0)], "slice_id int, t0 double, t1 double")
    power = spark.createDataFrame([(0.0, 1.0), (600.0, 2.0), (1300.0, 3.0), (1300.1, 4.0)], "ts double, mw double")
    assert sorted(values(profiling.within(power, slices), "slice_id", "ts")) == [(1, 0.0), (1, 600.0), (2, 600.0), (2, 1300.0)]
    assert sorted(values(profiling.energy_per_slice(power, slices), "slice_id", "n")) == [(1, 2), (2, 2)]


def test_islands(spark):
    rows = spark.createDataFrame([("n", i, f) for i, f in enumerate([True, True, False, False, True])], "net string, idx int, compat boolean")
    assert values(scheduling.islands(rows).orderBy("first"), "first", "last", "compat") == [(0, 1, True), (2, 3, False), (4, 4, True)]
    picked = scheduling.selected(scheduling.islands(rows), 1, 1)
    assert values(picked, "first") == [(0,)]
    assert scheduling.selected(scheduling.islands(rows), 0, 1).count() == 2 and scheduling.selected(scheduling.islands(rows), 1, 3).count() == 0


def test_schedule_cost(spark):
    mib = 1 << 20
    rows = spark.createDataFrame([("s", i, p, t, 0.0, t, 0.0, z) for i, (p, t, z) in enumerate([("G", 1.0, mib), ("D", 1.0, 2 * mib), ("G", 1.5, 0)])], "schedule_id string, idx int, proc string, gpu_ms double, gpu_mj double, dla_ms double, dla_mj double, size long")
    (r,) = scheduling.schedule_cost(rows).collect()
    assert (round(r.time_ms, 9), r.transitions) == (3.85, 2)


def brute_schedule(layers, limit, share):
    budget, best = share * sum(x[1] for x in layers), None
    for procs in itertools.product("GD", repeat=len(layers)):
        changes = sum(a != b for a, b in zip(procs, procs[1:], strict=False))
        if changes > limit or any(p == "D" and not x[5] for p, x in zip(procs, layers, strict=True)):
            continue
        t = e = 0.0
        for i, (p, x) in enumerate(zip(procs, layers, strict=True)):
            t, e = t + (x[0] if p == "G" else x[2]), e + (x[1] if p == "G" else x[3])
            if i and procs[i - 1] != p:
                mb = layers[i - 1][4] / (1 << 20)
                t, e = t + 0.1 + 0.05 * mb, e + 0.01 + 0.005 * mb
        if e <= budget + 1e-9 and (best is None or (t, e) < best):
            best = (t, e)
    return best or (sum(x[0] for x in layers), sum(x[1] for x in layers))


@pytest.mark.parametrize("seed", range(3))
def test_solvers_against_all_schedules(spark, seed):
    rng = random.Random(seed)
    layers = [(rng.uniform(1, 2), rng.uniform(5, 9), rng.uniform(1, 4), rng.uniform(1, 6), rng.randint(0, 1 << 21), rng.random() < 0.8) for _ in range(7)]
    df = spark.createDataFrame([("n", i, *x) for i, x in enumerate(layers)], "net string, idx int, gpu_ms double, gpu_mj double, dla_ms double, dla_mj double, size long, compat boolean")
    for limit in (1, 3):
        (r,) = scheduling.solved(df, 0.8, limit).collect()
        assert (r.time_ms, r.energy_mj) == pytest.approx(brute_schedule(layers, limit, 0.8), abs=1e-6)
        named = df.withColumns({"schedule_id": F.lit(1), "proc": F.substring(F.lit(r.procs), F.col("idx") + 1, F.lit(1))})
        (own,) = scheduling.schedule_cost(named).collect()
        assert (own.time_ms, own.energy_mj, own.transitions) == pytest.approx((r.time_ms, r.energy_mj, r.transitions), abs=1e-6)
    (r,) = scheduling.solved_one_change(df, 0.8).collect()
    assert r.time_ms == pytest.approx(brute_schedule(layers, 1, 0.8)[0], abs=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_solver_in_rounds(spark, seed):
    """Against the walk over whole networks, and for small ones against all schedules."""
    rng = random.Random(seed)
    nets = {f"n{n}": [(rng.uniform(1, 2), rng.uniform(5, 9), rng.uniform(1, 4), rng.choice([1.0, rng.uniform(1, 6)]), rng.randint(0, 1 << 21), rng.random() < 0.9) for _ in range(n)] for n in (1, 2, 7, 9, 40)}
    nets["whole"] = [(1.0, 1.0, 1.0, 5.0, 0, True)] * 9  # nothing fits the budget
    nets["none"] = [(1.0, 1.0, 1.0, 0.1, 0, False)] * 9
    rows = [(net, i, *x) for net, own in nets.items() for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "net string, idx int, gpu_ms double, gpu_mj double, dla_ms double, dla_mj double, size long, compat boolean")
    for limit in (0, 1, 3, 4):
        got = {r.net: r for r in segments.solved_in_rounds(df, 0.8, limit, block=2, fan=2).collect()}
        want = {r.net: r for r in scheduling.solved(df, 0.8, limit).collect()}
        assert {n: (r.time_ms, r.energy_mj) for n, r in got.items()} == {n: pytest.approx((r.time_ms, r.energy_mj), abs=1e-6) for n, r in want.items()}
        for net in ("n7", "n9"):
            assert (got[net].time_ms, got[net].energy_mj) == pytest.approx(brute_schedule(nets[net], limit, 0.8), abs=1e-6)
        for net, r in got.items():
            edges = [0, *r.cuts, len(nets[net])]
            procs = "".join("GD"[(j + (r.first_proc == "D")) % 2] * (b - a) for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
            assert r.transitions == len(r.cuts) <= limit
            (own,) = scheduling.schedule_cost(df.where(F.col("net") == net).withColumns({"schedule_id": F.lit(1), "proc": F.substring(F.lit(procs), F.col("idx") + 1, F.lit(1))})).collect() if seed == 0 else (r,)
            assert (own.time_ms, own.energy_mj) == pytest.approx((r.time_ms, r.energy_mj), abs=1e-6)


def test_compared_schedules(spark):
    layers = spark.createDataFrame([("n", 0, 4.0, 8.0, 5.0, 4.0, 1 << 20, True), ("n", 1, 4.0, 8.0, 5.0, 4.0, 1 << 20, True)], "net string, idx int, gpu_ms double, gpu_mj double, dla_ms double, dla_mj double, size long, compat boolean")
    chosen = spark.createDataFrame([("n", 10.0, 8.0)], "net string, time_ms double, energy_mj double")
    (r,) = scheduling.compared_schedules(chosen, layers).collect()
    assert (r.fps, r.watts) == (100, 0.8)
    assert (r.time_vs_gpu, r.energy_vs_gpu, r.time_vs_dla, r.energy_vs_dla) == (25, -50, 0, 0)


def test_split_ranges(spark):
    sizes = spark.createDataFrame([("n", 5)], "net string, n int")
    cuts = spark.createDataFrame([("n", 1), ("n", 3)], "net string, idx int")
    assert values(scheduling.split_ranges(cuts, sizes).orderBy("part"), "first", "last") == [(0, 1), (2, 3), (4, 4)]
    with pytest.raises(Exception, match="leaves nothing"):
        scheduling.split_ranges(spark.createDataFrame([("n", 4)], "net string, idx int"), sizes).collect()


def test_pareto(spark):
    rows = spark.createDataFrame([("f", i, float(c), float(a)) for i, (c, a) in enumerate([(1, 30), (2, 31), (3, 50), (3, 45), (4, 50), (6, 52)])], "family string, point_id int, cost double, acc double")
    got = [r.frontier for r in benchmarks.pareto(rows).orderBy("point_id").collect()]
    assert got == [True, False, True, False, False, True]


@pytest.mark.parametrize("seed", range(4))
def test_hulls_of_parts(spark, seed):
    """Thinned parts lead to the same frontier as one walk; ties, lines and copies too."""
    rng = random.Random(seed)
    number = [lambda: rng.random(), lambda: float(rng.randrange(12)), lambda: rng.choice([0.1, 0.2, 0.3, 0.7]), lambda: rng.gauss(0, 1e6)][seed]
    for _ in range(200):
        points = [(number(), number()) for _ in range(rng.randrange(1, 60))] + [(float(i), 2.0 * i) for i in range(rng.randrange(4))]
        if rng.random() < 0.3:
            points = [(c, (abs(c) % 50) ** 0.5) for c, _ in points]
        ordered = sorted(points, key=lambda p: (p[0], -p[1]))
        whole = [ordered[i] for i in hulls.walked(*map(list, zip(*ordered, strict=True)), 1e-9)]
        parts = [points[k::3] for k in range(3)]
        left = sorted((own[i] for own in parts if own for i in hulls.thinned(np.array([p[0] for p in own]), np.array([p[1] for p in own]), 1e-9)), key=lambda p: (p[0], -p[1]))
        assert [left[i] for i in hulls.walked(*map(list, zip(*left, strict=True)), 1e-9)] == whole


def test_a_large_family(spark):
    """100,000 points of one family, all of them on an arc, and as many below it."""
    n = 100_000
    arc = spark.range(n).select(F.lit("f").alias("family"), F.col("id").alias("point_id"), (F.col("id") * 1.0).alias("cost"), (F.sqrt("id") * 1e4).alias("acc"))
    below = arc.select("family", (F.col("point_id") + n).alias("point_id"), (F.col("cost") + 1).alias("cost"), (F.col("acc") - 50).alias("acc"))
    began = time.monotonic()
    got = benchmarks.pareto(arc.unionByName(below).repartition(4)).where("frontier").agg(F.count("*").alias("n"), F.max("point_id").alias("last")).first()
    assert got.last < n and got.n > 0.9 * n and time.monotonic() - began < 60


def test_speedups_and_scaling(spark):
    configs = spark.createDataFrame([(1, "base"), (1, "fast"), (1, "none")], "device int, config string")
    results = spark.createDataFrame([(1, "base", 4.0, None), (1, "fast", None, 1.0)], "device int, config string, mean double, mean_ms double")
    assert {r.config: r.speedup for r in benchmarks.speedups(configs, results, ["device", "config"], "base").collect()} == {"base": 1.0, "fast": 4.0, "none": 0.0}
    tp = spark.createDataFrame([("m", 1, 100.0), ("m", 4, 300.0), ("x", 4, 1.0)], "model string, batch_size int, throughput double")
    assert sorted(values(benchmarks.scaling_efficiency(tp), "model", "batch_size", "efficiency")) == [("m", 1, 1.0), ("m", 4, 0.75)]


def test_batches_drop_the_incomplete_last(spark):
    rows = spark.range(7).withColumn("g", F.lit(1))
    assert image.batched(rows, 3, "g", "id").count() == 6


def test_parse_shapes(spark):
    rows = spark.createDataFrame([("a:1,,2",), ("input:1,3,224,224",), ("scalar:1",)], "arg string")
    got = [(r.s.name, r.s.dims) for r in rows.select(scalars.parsed_shape(F.col("arg")).alias("s")).collect()]
    assert got == [("a", [1, 2]), ("input", [1, 3, 224, 224]), ("scalar", [1])]
    for bad in ("input_1_3_224_224", "input:1,three,224,224", "input:"):
        with pytest.raises(Exception, match="not NAME"):
            spark.createDataFrame([(bad,)], "arg string").select(scalars.parsed_shape(F.col("arg")).alias("s")).collect()


def test_image_sizes(spark):
    rows = spark.createDataFrame([(None, False, None), (320, False, None), (320, True, None), (641, False, 32), (5, False, 32)], "s int, e boolean, d int")
    got = [r[0] for r in rows.select(scalars.image_size(F.col("s"), F.lit(640), F.col("e"), F.col("d"))).collect()]
    assert got == [640, 320, 640, 640, 32]


def test_small_rules(spark):
    row = spark.range(1).select(scalars.rounded_ms(F.lit(0.0123456)).alias("a"), scheduling.static_shape(F.array(F.lit(-1), F.lit(3))).alias("b"), profiling.tensor_bytes(F.array(F.lit(-1), F.lit(3)), F.lit("HALF")).alias("c"), scalars.override(F.lit(0.0), F.lit(0.1)).alias("d")).first()
    assert tuple(row) == (12.35, [1, 3], 6, 0.0)


def test_exact_medians(spark):
    rng = random.Random(3)
    rows = [(g, v) for g, n in (("one", 1), ("two", 2), ("odd", 801), ("even", 800)) for v in (rng.choice([1.5, 2.5, rng.random() * 9]) for _ in range(n))]
    rows += [("tie", 4.0)] * 50 + [("gap", float(i // 10 * 100)) for i in range(20)] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in profiling.exact_medians(df, ["g"], "v").collect()}
    want = {g: statistics.median(v for k, v in rows if k == g and v is not None) for g in {k for k, v in rows if v is not None}}
    assert got == want
    assert {r.g: r["median"] for r in profiling.exact_medians(df, ["g"], "v", cuts=2).collect()} == want


def test_resampling_of_broken_rows(spark):
    rows = [(1, y, x, c, 10 * y + x) for y in range(2) for x in range(2) for c in range(3)] + [(2, 1, x, c, 7) for x in range(2) for c in range(3)] + [(3, 0, 0, 0, 5), (3, 1, 0, 0, 5)]
    pixels = spark.createDataFrame(rows, "image_id int, y int, x int, c int, value int")
    sizes = spark.createDataFrame([(i, 2, 2) for i in (1, 2, 3)], "image_id int, w int, h int")
    got = {(r.image_id, r.y, r.x, r.c): r.value for r in image.resampled(pixels, image.linear_geometry(sizes, 2, 2), 2, 2).collect()}
    assert len(got) == 36
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, y, x, c): 10 * y + x for y in range(2) for x in range(2) for c in range(3)}
    assert {v for k, v in got.items() if k[0] == 3} == {None}
    assert {v for k, v in got.items() if k[:2] == (2, 0)} == {None}


@pytest.mark.parametrize("each, patterns", [(1000, 1000), (7, 5)])
def test_names_that_contain_layers(spark, each, patterns):
    """Names of 0 to 7 characters and long ones, over every pair."""
    rng = random.Random(each)
    word = lambda n: "".join(rng.choice("abü") for _ in range(n))
    layers = [(net, word(rng.randrange(8))) for net in "xyz" for _ in range(30)] + [("x", None), (None, "a"), ("w", "a"), ("x", "ab" * 9)]
    names = [(net, word(rng.randrange(25)), rng.randrange(40)) for net in "xyz" for _ in range(40)] + [("x", "c" + "ab" * 9, 99), ("x", None, 1), ("v", "a", 1)]
    got = {(r.net, r.layer): (r.pos, r.name) for r in first_containing(spark.createDataFrame(layers, "net string, layer string"), spark.createDataFrame(names, "net string, name string, pos int"), each, patterns).collect()}
    want = {}
    for net, layer in layers:
        own = [(pos, name) for other, name, pos in names if other == net and name is not None and layer is not None and layer in name]
        if own:
            want[net, layer] = min(own)
    assert got == want


def test_patches_of_unequal_images(spark):
    """Every pixel of every patch, against the resized image by itself."""
    rng = random.Random(1)
    sizes = {1: (5, 3), 2: (4, 4), 3: (11, 130), 4: (1, 1)}
    data = {i: [[rng.randrange(256) for _ in range(3 * w)] for _ in range(h)] for i, (w, h) in sizes.items()}
    rows = spark.createDataFrame([(i, y, r) for i, own in data.items() for y, r in enumerate(own)], "image_id int, y int, row array<int>")
    images = spark.createDataFrame([(i, *s) for i, s in sizes.items()], "image_id int, w int, h int")
    grid = {(r.image_id, r.tile): r for r in image.patch_grid(images, 4, 4, 0.25, 0.25).collect()}
    assert {i: (r.nw, r.nh) for (i, _), r in grid.items()} == {1: (7, 4), 2: (4, 4), 3: (13, 130), 4: (4, 4)}
    got = {(r.image_id, r.tile, r.y): r.row for r in image.image_patches(rows, images, 4, 4, 0.25, 0.25).collect()}
    assert len(got) == 4 * len(grid)
    for (i, tile, y), row in got.items():
        g, (w, h) = grid[i, tile], sizes[i]
        for k, v in enumerate(row):
            sx, sy = (max(0.0, min((at + 0.5) * n / new - 0.5, n - 1)) for at, n, new in ((g.x0 + k // 3, w, g.nw), (g.y0 + y, h, g.nh)))
            a, b = int(sx), int(sy)
            tap = lambda yy, xx: data[i][min(yy, h - 1)][3 * min(xx, w - 1) + k % 3]  # noqa: E731, B023
            top, low = (tap(yy, a) * (1 - (sx - a)) + tap(yy, a + 1) * (sx - a) for yy in (b, b + 1))
            assert v == int(round(top * (1 - (sy - b)) + low * (sy - b), 6) // 1)


@pytest.mark.parametrize("seed", range(2))
def test_ports_of_all_parts(spark, seed):
    rng = random.Random(seed)
    rows = [("n", node, f"t{rng.randrange(20)}", rng.choice(["in", "out"])) for node in range(12) for _ in range(3)]
    io = spark.createDataFrame(rows, "net string, node int, tensor string, dir string")
    bounds = [(0, 0), (1, 4), (5, 5), (6, 11)]
    ranges = spark.createDataFrame([("n", k, a, b) for k, (a, b) in enumerate(bounds)], "net string, part int, first int, last int")
    got = {(r.part, r.tensor, r.port) for r in scheduling.split_ports(io, ranges).collect()}
    assert got == {(k, r.tensor, r.port) for k, (a, b) in enumerate(bounds) for r in scheduling.subgraph_ports(io, a, b).collect()}


def test_networks_without_layers(spark):
    rows = spark.createDataFrame([("a", 0, True)], "net string, idx int, compat boolean")
    got = scheduling.islands(rows, spark.createDataFrame([("a",), ("b",)], "net string"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0, 0, 1, True), ("b", 0, 0, -1, 0, False)]


def test_settings_of_models(spark):
    kind = "model int, version int, low double, high double, mean array<double>, std array<double>"
    rows = [(1, 1, 0.0, 1.0, None, None), (1, 2, -1.0, 1.0, None, None), (2, 1, 0.0, 1.0, [0.5, 0.5, 0.5], [1.0, 1.0, 2.0])]
    pixels = spark.createDataFrame([(7, 1, 0, 0, 0, 255), (8, 2, 0, 0, 0, 255), (9, 3, 0, 0, 0, 1)], "image_id int, model int, y int, x int, c int, value int")
    got = image.prepared(pixels, image.current_settings(spark.createDataFrame(rows, kind)), 1, 1)
    assert sorted(map(tuple, got.collect())) == [(7, 2, 1.0), (8, 2, 0.25)]
    for mean, std in (([0.5], [1.0]), ([0.5] * 3, None), (None, [1.0] * 3), ([0.5] * 3, [1.0] * 2)):
        with pytest.raises(Exception, match="three values each: 4"):
            image.current_settings(spark.createDataFrame([(4, 1, 0.0, 1.0, mean, std)], kind)).collect()
