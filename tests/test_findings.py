"""Small tables on which queries once differed from their SQL, or did more or less work than they should."""

import itertools
import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkvision.operators import image, profiling, running, scheduling, segments
from sparkvision.plans import registry, views
from sparkvision.sources import catalog, files

from .test_queries import ordered


def against_sql(spark, folder, name: str, **tables: pd.DataFrame) -> pd.DataFrame:
    """The query's rows on these tables, which its SQL must give too."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, df in tables.items():
        df.to_parquet(f"{folder}/{t}.parquet", coerce_timestamps="us")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, str(folder)).toPandas()
    pd.testing.assert_frame_equal(ordered(got), ordered(con.execute(registry.SQL[name]).df()))
    return got


def lines(rows: list[tuple]) -> pd.DataFrame:
    """lineitem of (order, line, part, supplier, quantity, thousandths of the score)."""
    own = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "m"])
    return own.assign(l_quantity=own.l_quantity.astype(float), l_extendedprice=own.m / 100 + 0.001).drop(columns="m")


def test_scores_that_tie(spark, tmp_path):
    """0.720 x 37 and 0.555 x 48 hundredths are one score, so the box with the smaller id hides the other."""
    rows = [(8, i, 3, 1, 50, {1: 720, 4: 555}.get(i, 0)) for i in range(5)]
    got = against_sql(spark, tmp_path, "graph_suppression", lineitem=lines(rows))
    assert len(got[got.class_id == 0]) == 1


def test_boxes_of_every_tile(spark, tmp_path):
    """An image of two tiles: a box of each network coordinate stands in both."""
    orders = pd.DataFrame({"o_orderkey": [1], "o_custkey": [18]})  # 986 x 294
    got = against_sql(spark, tmp_path, "tile_merge", lineitem=lines([(8, 1, 3, 1, 5, 900)]), orders=orders)
    assert sorted(got.x1) == [3, 349]


def shuffled_rows(spark, run) -> int:
    """Rows that the stages of run() write into shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(store.stageList(None, False, False, none, None).apply, range(store.stageList(None, False, False, none, None).size()))}
    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_pairs_of_slices_are_not_shuffled(spark):
    """Slices of any length meet what they hold, and 40,000 and more pairs cost no rows of shuffle each."""
    rng = random.Random(4)
    times = [rng.choice([rng.uniform(0, 1000), float(rng.randint(0, 50))]) for _ in range(400)]
    spans = [(i, a, a + rng.choice([0.0, 1.0, 50.0, 900.0, 900.0, 900.0])) for i, a in enumerate(rng.uniform(-400, 500) for _ in range(400))]
    samples = spark.createDataFrame([(t, i) for i, t in enumerate(times)] + [(None, -1)], "ts double, k int")
    slices = spark.createDataFrame([*spans, (-1, None, 5.0), (-2, 7.0, 6.0), (-3, 5.0, 5.0)], "slice_id int, t0 double, t1 double")
    want = sorted((s, i) for s, a, b in [*spans, (-3, 5.0, 5.0)] for i, t in enumerate(times) if a <= t <= b)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = profiling.within(samples, slices)
        found = []
        n = shuffled_rows(spark, lambda: found.extend(own.select("slice_id", "k").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, found)) == want and len(want) > 40_000
    assert n < len(want) / 2


def test_tensors_are_dealt_out(spark):
    """Tensors of few specs in one file are made by several tasks; a null key has null values, a null type is no whole number."""
    specs = spark.createDataFrame([(1, [2], "float32"), (None, [2], "float32"), (None, [2], "int8"), (3, None, "int8"), (4, [1], None)], "i int, shape array<int>, dtype string").coalesce(1)
    own = catalog.random_inputs(specs)
    got = {(r.i, str(r.shape), r.dtype): r.data for r in own.collect()}
    assert own.rdd.getNumPartitions() > 1
    assert got[None, "[2]", "float32"] == [None, None] and got[None, "[2]", "int8"] == [0, 0]
    assert got[3, "None", "int8"] == [] and len(got[4, "[1]", None]) == 1 and 0 < got[4, "[1]", None][0] < 1


def test_failures_cost_a_call_each(spark, tmp_path):
    """Where failing rows have something in common, a model is called little more than once for each of them."""
    calls = str(tmp_path / "calls")

    def model(batches):
        for b in batches:
            with open(calls, "a") as f:
                f.write("x")
            yield b[b.kind != "b"].assign(y=b.id * 2)[["id", "y"]]  # what was given before an error does not count
            if (b.kind == "b").any():
                raise ValueError(f"no {b.id.max()}")

    rows = spark.range(0, 10000, 1, 1).select("id", F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("kind"), (F.col("id") % 3 == 0).alias("third"))
    good, dead, counts = files.survived(rows, model, "id long, y long", str(tmp_path / "out"))
    assert sorted(map(tuple, good.collect())) == [(i, 2 * i) for i in range(10000) if i % 5]
    assert sorted((r.id, r.kind, r.third, r.error) for r in dead.collect()) == [(i, "b", i % 3 == 0, f"ValueError: no {i}") for i in range(0, 10000, 5)]
    assert counts == {"results": 8000, "failures": 2000}
    with open(calls) as f:
        assert len(f.read()) < 5000


def test_the_smallest_segments(spark):
    """More layers than a smallest segment has, in a network whose layers mostly cannot move: as a walk over the network has it."""
    rng = random.Random(5)
    rows = [(f"n{k}", i, rng.uniform(1, 2), rng.uniform(1, 2), rng.uniform(1, 3), rng.uniform(0.3, 1), rng.randint(1, 1 << 22), rng.random() < share) for k, share in enumerate((0.0, 0.5, 1.0)) for i in range(segments.leaf_size(3) + 5)]
    layers = spark.createDataFrame(rows, "net string, idx int, gpu_ms double, gpu_mj double, dla_ms double, dla_mj double, size long, compat boolean")
    got = {r.net: r for r in segments.solved_in_rounds(layers, block=34).collect()}
    for r in scheduling.solved(layers, max_transitions=3).collect():
        assert (got[r.net].time_ms, got[r.net].energy_mj, got[r.net].transitions) == (pytest.approx(r.time_ms), pytest.approx(r.energy_mj), r.transitions)
    assert len(got) == 3 and max(r.transitions for r in got.values()) > 1


def test_boxes_know_their_patch(spark, sf_dir):
    """Boxes are dealt out by image twice at most: lines, and images; suppression needs no further shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["patch_merge"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        agnostic = registry.QUERIES["nms_agnostic"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and agnostic.count("Exchange hashpartitioning") == 1


def parts(keys: list[int]) -> pd.DataFrame:
    return pd.DataFrame([(k, f"name {k % 7}", f"Brand#{k % 9 // 8}", f"type {k % 5}", k % 50 + 1, k % 1000 / 8) for k in keys], columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


@pytest.mark.parametrize("name", ["fused_layer_map", "tensor_sizes"])
def test_layers_are_numbered_across_blocks_of_keys(spark, tmp_path, name):
    """Two networks of unequal size over many blocks, one key at a block's edge, and blocks without a layer."""
    against_sql(spark, tmp_path, name, part=parts([*range(1, 1200), 4095, 4096, *range(9000, 9400), *range(70_000, 70_300)]))


def test_no_task_holds_a_network(spark, tmp_path):
    parts(range(1, 40_000)).assign(p_brand="one").to_parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rows in (views.layers(spark, str(tmp_path)), registry.profiling_queries.profiled(spark, str(tmp_path))):
            sizes = [len(p) for p in rows.rdd.glom().collect()]
            assert max(sizes) < 0.7 * sum(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_of_pixels_are_worked_out_once(spark):
    """What makes the rows stands in the plan once; rows without pixels, and without an array, give none."""
    rows = spark.createDataFrame([(1, 0, [1, 2, 3, 4, 5, None]), (1, 1, []), (2, 0, None), (None, 3, [7, 8, 9])], "image_id int, y int, row array<int>")
    own = image.pixels_of(rows.withColumn("row", F.transform("row", lambda v: v * 2)))
    assert own._jdf.queryExecution().executedPlan().toString().count("transform(") == 1
    assert own.dtypes == [("image_id", "int"), ("y", "int"), ("x", "int"), ("c", "int"), ("value", "int")]
    assert sorted(map(tuple, own.collect()), key=str) == sorted([(1, 0, 0, 0, 2), (1, 0, 0, 1, 4), (1, 0, 0, 2, 6), (1, 0, 1, 0, 8), (1, 0, 1, 1, 10), (1, 0, 1, 2, None), (None, 3, 0, 0, 14), (None, 3, 0, 1, 16), (None, 3, 0, 2, 18)], key=str)


def test_lines_beside_missing_and_short_rows(spark):
    """Four taps by hand: padding is filled, also where nothing is left of an image's width; beside a row that is missing, short or has a null, values are null."""
    rng = random.Random(7)
    sizes = [(1, 5, 4), (2, 2, 7), (3, 9, 2), (4, 3, 3)]
    source = {(k, y): [rng.randrange(256) for _ in range(w * 3)] for k, w, h in sizes for y in range(h)}
    del source[1, 2]
    source[2, 3].pop()
    source[4, 0][4] = None
    images = spark.createDataFrame([*sizes, (5, 2, 2), (6, 1, 100), (None, 2, 2)], "image_id int, w int, h int")
    geometry = image.letterbox_geometry(images, 6, 8).withColumns({"out_w": F.lit(6), "out_h": F.lit(8)})
    rows = spark.createDataFrame([(*k, v) for k, v in source.items()] + [(None, 0, [1] * 6)], "image_id int, y int, row array<int>")
    got = {(r.image_id, r.y): r.row for r in image.resampled_rows(rows, geometry).collect()}
    assert len(got) == 56

    def tap(k, y, x, c, w):
        row = source.get((k, y))
        return row[x * 3 + c] if row and len(row) == w * 3 else None

    for k, w, h in [*sizes, (5, 2, 2), (6, 1, 100)]:
        scale = min(6 / w, 8 / h)
        nw, nh = int(w * scale), int(h * scale)
        px, py = (6 - nw) // 2, (8 - nh) // 2
        for y, x, c in itertools.product(range(8), range(6), range(3)):
            if not (px <= x < px + nw and py <= y < py + nh):
                want = 114
            else:
                sx, sy = (max(0.0, min((at - pad + 0.5) * n / new - 0.5, n - 1)) for at, pad, n, new in ((x, px, w, nw), (y, py, h, nh)))
                x0, y0 = int(sx), int(sy)
                x1, y1, fx, fy = min(x0 + 1, w - 1), min(y0 + 1, h - 1), sx - x0, sy - y0
                four = [tap(k, b, a, c, w) for b, a in ((y0, x0), (y0, x1), (y1, x0), (y1, x1))]
                want = None if None in four else math.floor(round((four[0] * (1 - fx) + four[1] * fx) * (1 - fy) + (four[2] * (1 - fx) + four[3] * fx) * fy, 6))
            assert got[k, y][x * 3 + c] == want, (k, y, x, c)


def test_ranges_by_cuts(spark):
    """A value's range is the number of cuts up to it, whatever the cuts; null values have none to count."""
    values_ = [-math.inf, -2.5, -0.0, 0.0, 1.0, 1.5, 7.0, math.inf]
    rows = spark.createDataFrame([(v,) for v in values_], "t double")
    for cuts in ([], [0.0], [-2.5, 0.0, 1.0, 7.0], [-math.inf, 1.5, math.inf]):
        finite = [c for c in cuts if math.isfinite(c)]
        got = sorted((r.t, int(r.at)) for r in running.range_of(rows, "t", cuts, "at").collect() if r.t)
        assert got == sorted((v, sum(c <= v for c in finite)) for v in values_ if v)


def test_slices_over_odd_samples(spark, monkeypatch):
    """Null, equal and reversed ends, repeated slices and samples, from none to many times in a slice; the samples' times are cut into ranges once."""
    rng = random.Random(11)
    samples = [(rng.randrange(400) / 4, k) for k in range(600)] + [(None, 600), (50.0, 601), (50.0, 601)]
    slices = [(k, t0, t0 + rng.choice([-1.0, 0.0, 0.25, 1.0, 2.0, 4.0, 30.0, 200.0])) for k in range(150) for t0 in [rng.randrange(-40, 440) / 4]]
    slices += [*slices[:9], (200, None, 5.0), (201, 5.0, None), (None, 3.0, 9.0)]
    made, cuts_of = [], profiling.cuts_of
    monkeypatch.setattr(profiling, "cuts_of", lambda rows, order: made.append(order) or cuts_of(rows, order))
    both = spark.createDataFrame(samples, "ts double, n int"), spark.createDataFrame(slices, "k int, t0 double, t1 double")
    key = lambda r: tuple((v is None, v or 0) for v in r)
    want = [(k, t0, t1, ts, n) for k, t0, t1 in slices for ts, n in samples if None not in (t0, t1, ts) and t0 <= ts <= t1]
    assert sorted(map(tuple, profiling.within(*both).collect()), key=key) == sorted(want, key=key)
    assert made == ["t"]
    none = both[0].limit(0)
    assert profiling.within(none, both[1]).count() == 0 == profiling.within(both[0], both[1].limit(0)).count()
