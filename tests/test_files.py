import json

import pytest
from pyspark.sql import functions as F

from sparkvision.operators import image
from sparkvision.sources import batcher, catalog, files, parts, scan


def test_image_files_are_filtered(spark, tmp_path):
    for name in ("b.jpg", "a.png", "c.JPG", "d.txt", "e.jpeg"):
        (tmp_path / name).write_bytes(bytes([2, 1, 0] * 2))
    found = lambda *n: sorted(r.path.rsplit("/", 1)[1] for r in files.image_files(spark, str(tmp_path), *n).collect())
    assert found() == ["a.png", "b.jpg", "e.jpeg"] and found(2) == ["a.png", "b.jpg"]
    with pytest.raises(ValueError):
        files.image_files(spark, str(tmp_path), 1)


def test_decoded_pixels(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes(range(12)))
    images = files.decoded_images(files.image_files(spark, str(tmp_path)), lambda raw: (2, 2, raw))
    rows = {(r.y, r.x, r.c): r.value for r in files.pixels(images).collect()}
    assert rows == {(i // 6, i // 3 % 2, i % 3): i for i in range(12)}


def test_unreadable_image_raises(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    with pytest.raises(Exception, match="a.png"):
        files.decoded_images(files.image_files(spark, str(tmp_path)), lambda raw: None).collect()


def test_store_round_trip(spark, tmp_path):
    text = {"fw": {"m": {"640": {"mean": 1.0, "median": 1.5, "min": 0.5, "max": 2.0}}, "n": {}}, "none": {}}
    (tmp_path / "s.json").write_text(json.dumps(text))
    rows = files.read_store(spark, str(tmp_path / "s.json"))
    assert [(r.framework, r.model, r.key, r.metrics.mean) for r in rows.collect()] == [("fw", "m", "640", 1.0)]
    files.write_store(rows, str(tmp_path / "out"))
    again = files.read_store(spark, str(tmp_path / "out"))
    assert again.collect() == rows.collect()


def test_batches(spark, tmp_path):
    made = catalog.synthetic_batches(spark.range(3).withColumnRenamed("id", "batch_id"), (2, 3), -1.0, 1.0, seed=1)
    assert files.write_batches(made, str(tmp_path / "b")) == 3
    rows = files.read_batches(spark, str(tmp_path / "b")).collect()
    assert all(len(r.data) == 6 and all(-1 <= x < 1 for x in r.data) for r in rows)
    assert sorted(rows) == sorted(made.collect())
    with pytest.raises(ValueError):
        files.write_batches(made.limit(0), str(tmp_path / "n"))
    with pytest.raises(ValueError):
        catalog.synthetic_batches(made, (0,))


def test_rst_table(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b,2"), (1, "a,1")], "place int, row string")
    lines = files.rst_table(rows, "T", ["x", "y"], ["place"])
    files.write_rst(lines, str(tmp_path / "t"))
    found = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert found == [".. csv-table:: T", '   :header: "x","y"', "", "   a,1", "   b,2"]


def test_profile_sink(spark, tmp_path):
    profile = spark.createDataFrame([(1, 1, "a", 1.0, 1.0, 1.0, 1.0), (1, 2, "b", 2.0, 2.0, 2.0, 2.0)], "run_id int, place int, layer string, mean double, median double, minimum double, maximum double")
    totals = spark.createDataFrame([(1, 0, 3.0), (1, 1, 5.0)], "run_id int, pos int, total double")
    files.write_profile(profile, totals, str(tmp_path / "p"))
    r = spark.read.json(str(tmp_path / "p")).first()
    assert (r.iterations, r.total_time.mean, [x.layer for x in r.layers]) == (2, 4.0, ["a", "b"])
    assert "raw" not in r.layers[0].asDict()


def test_cache(spark):
    old = spark.createDataFrame([("a", "engine", "1"), ("a", "cache", "2")], "name string, ext string, payload string")
    new = spark.createDataFrame([("a", "engine", "3"), ("b", "onnx", "4")], "name string, ext string, payload string")
    assert {tuple(r) for r in files.put_in_cache(old, new).collect()} == {("a", "engine", "1"), ("a", "cache", "2"), ("b", "onnx", "4")}
    assert ("a", "engine", "3") in {tuple(r) for r in files.put_in_cache(old, new, True).collect()}
    assert [r.ext for r in files.found_in_cache(old, "a").collect()] == ["engine", "cache"]
    assert files.removed_from_cache(old, "a", "cache").count() == 1
    with pytest.raises(Exception, match="not in the cache"):
        files.removed_from_cache(old, "z", "cache").collect()


def test_catalog(spark, tmp_path):
    (tmp_path / "yolov8.json").write_text(json.dumps({"yolov8n": {"url": "u"}, "yolov8m": {}}))
    (tmp_path / "deim.json").write_text(json.dumps({"deim-s": {}}))
    own = catalog.read_catalog(spark, str(tmp_path / "*.json"))
    assert {(r.family, r.model) for r in own.collect()} == {("yolov8", "yolov8n"), ("yolov8", "yolov8m"), ("deim", "deim-s")}
    assert catalog.supported_models(own).count() == 3
    rules = [("deim", "deimv2", "one"), ("deim", None, "two"), ("yolo", None, "three")]
    rows = spark.createDataFrame([("deim-s",), ("deimv2-s",), ("yolov8n",), ("x",)], "name string")
    assert [r[0] for r in rows.select(catalog.routed(F.col("name"), rules)).collect()] == ["one", "two", "three", None]


def test_catalog_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("007", "m/n", {"url": "a b"}), ("007", "o", {}), ("x y#1", "p", {"k": "\u00e9"})], "family string, model string, config map<string,string>")
    catalog.write_catalog(rows, str(tmp_path / "c"))
    got = catalog.read_catalog(spark, str(tmp_path / "c"))
    assert sorted((r.family, r.model, r.config) for r in got.collect()) == sorted((r.family, r.model, r.config) for r in rows.collect())


def test_store_of_odd_names(spark, tmp_path):
    m = (1.0, 1.0, None, 2.0)
    rows = spark.createDataFrame([("a/b", "m", "1", m), ("a/b", "n", "1", m), ("2", "m", "x y", m)], f"framework string, model string, key string, metrics {files.METRICS}")
    files.write_store(rows, str(tmp_path / "s"))
    assert sorted(files.read_store(spark, str(tmp_path / "s")).collect()[0].asDict()) == ["framework", "key", "metrics", "model"]
    assert {(r.framework, r.model, r.key) for r in files.read_store(spark, str(tmp_path / "s")).collect()} == {("a/b", "m", "1"), ("a/b", "n", "1"), ("2", "m", "x y")}
    files.write_store(rows.limit(0), str(tmp_path / "none"))
    assert files.read_store(spark, str(tmp_path / "none")).count() == 0


def test_batcher(spark):
    rows = batcher.read(spark, 5, (2, 2), lambda i: [i, 0, 0, 0], partitions=3)
    assert sorted((r.batch_id, r.shape, r.data[0]) for r in rows.collect()) == [(i, [2, 2], float(i)) for i in range(5)]
    assert batcher.read(spark, 0, (1,), lambda i: [0]).count() == 0
    with pytest.raises(Exception, match="has 1 values, not 2"):
        batcher.read(spark, 1, (2,), lambda i: [0]).collect()


def test_random_inputs(spark):
    specs = spark.createDataFrame([(1, [2, 3], "float32"), (2, [4], "int64"), (3, [4], "uint8"), (4, [0, 2], "float16")], "input_id int, shape array<int>, dtype string")
    got = {r.input_id: r.data for r in catalog.random_inputs(specs).collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 6, 2: 4, 3: 4, 4: 0}
    assert set(got[2] + got[3]) == {0.0} and all(0 <= x < 1 for x in got[1]) and len(set(got[1])) > 1
    assert got == {r.input_id: r.data for r in catalog.random_inputs(specs).collect()}
    assert got[1] != {r.input_id: r.data for r in catalog.random_inputs(specs, 1).collect()}[1]


def test_mean_and_std_need_three_values(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 0, 5)], "image_id int, y int, x int, c int, value int")
    with pytest.raises(ValueError, match="three"):
        image.normalised(pixels, 1, 1, (0.5, 0.5), (0.5, 0.5))
    with pytest.raises(ValueError, match="together"):
        image.normalised(pixels, 1, 1, (0.5, 0.5, 0.5), None)


def results(spark, names, bad=()):
    metrics = F.struct(*[F.lit(1.5).alias(c) for c in ("mean", "median", "min", "max")])
    own = spark.createDataFrame([(f, m, str(k)) for f, m in names for k in range(3)], "framework string, model string, key string").repartition(4)
    key = F.when(F.col("model").isin(*bad), F.raise_error(F.lit("broken"))).otherwise(F.col("key")) if bad else F.col("key")
    return own.select("framework", "model", key.alias("key"), metrics.alias("metrics"))


def test_store_in_parts_commits_or_stays(spark, tmp_path):
    at = str(tmp_path / "store")
    assert parts.read_parts(spark, at).count() == 0
    parts.write_parts(results(spark, [("a", "m"), ("a", "n"), ("b", "m")]), at)
    first = sorted(map(tuple, parts.read_parts(spark, at).collect()))
    assert len(first) == 9 and len(parts.listed(at)) == 3
    with pytest.raises(Exception, match="broken"):
        parts.write_parts(results(spark, [("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")], bad=["z"]), at)
    assert sorted(map(tuple, parts.read_parts(spark, at).collect())) == first
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == sorted([*parts.listed(at), "_parts.json"])  # nothing is left of it
    parts.write_parts(results(spark, [("c", "z")]), at)
    assert {(r.framework, r.model) for r in parts.read_parts(spark, at).collect()} == {("c", "z")}
    assert len(list((tmp_path / "store").iterdir())) == 2
    parts.write_parts(results(spark, [("c", "z")]).limit(0), at)
    assert parts.read_parts(spark, at).count() == 0


def test_a_failing_model_loses_only_its_rows(spark, tmp_path):
    def model(batches):
        for b in batches:
            if (b.x % 7 == 0).any():
                raise ValueError("seven")
            yield b.assign(y=b.x * 2)[["x", "y"]]

    rows = spark.range(100).select(F.col("id").alias("x"), F.col("id").cast("string").alias("name"), F.array("id").alias("more"))
    good, dead, counts = files.survived(rows, model, "x long, y long", str(tmp_path / "out"))
    assert sorted(map(tuple, good.collect())) == [(i, 2 * i) for i in range(100) if i % 7]
    assert sorted((r.x, r.name, r.more, r.error) for r in dead.collect()) == [(i, str(i), [i], "ValueError: seven") for i in range(0, 100, 7)]
    assert counts == {"results": 85, "failures": 15}


def test_scan_decides_before_it_reads(spark, tmp_path):
    sizes = {f"{i:03d}.{'png' if i % 3 else 'txt'}": i * 10 for i in range(50)}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes([n % 256]) * n)
    (tmp_path / "folder.png").mkdir()
    own = scan.scan(spark, str(tmp_path), most_bytes=1000)
    assert {r.name: (r.size, bytes(r.content)) for r in own.collect()} == {k: (n, bytes([n % 256]) * n) for k, n in sizes.items()}
    some = own.where(F.col("name").endswith(".png") & (F.col("size") >= 300) & ~F.col("name").startswith("04") & (F.length("content") > 0))
    assert sorted(r.name for r in some.collect()) == [k for k, n in sizes.items() if k.endswith("png") and n >= 300 and not k.startswith("04")]
    reader = scan.Reader(str(tmp_path), ["name"], 1000)
    left = list(reader.pushFilters([scan.StringEndsWith(("name",), ".png"), scan.Not(scan.EqualTo(("size",), 10)), scan.EqualTo(("content",), b"")]))
    assert [f.attribute for f in left] == [("content",)]
    assert sorted(x for p in reader.partitions() for x, _ in p.files) == [k for k, n in sizes.items() if k.endswith("png") and n != 10]
    assert scan.scan(spark, str(tmp_path), contents=False).columns == ["name", "size"]


def test_tasks_of_equal_bytes():
    files_ = [(str(i), size) for i, size in enumerate([100, 90, 80, 5, 5, 5, 5, 5, 5])]
    tasks = scan.balanced(files_, 100, 4)
    assert sorted(f for t in tasks for f in t) == sorted(files_) and len(tasks) == 3 and max(map(len, tasks)) <= 4
    assert max(sum(n for _, n in t) for t in tasks) <= 110 and scan.balanced([], 1, 1) == []
    assert len(scan.balanced([("a", 0)] * 9, 100, 2)) == 5


def test_missing_entries_are_errors(spark):
    cache = spark.createDataFrame([("a", "onnx", "1"), ("a", "engine", "2"), ("b", "cache", "3")], "name string, ext string, payload string")
    left = files.entries_removed(cache, cache.where("ext = 'engine'"))
    assert sorted(map(tuple, left.collect())) == [("a", "onnx", "1"), ("b", "cache", "3")]
    with pytest.raises(Exception, match="not in the cache: a.cache"):
        files.entries_removed(cache, cache.selectExpr("'a' AS name", "'cache' AS ext")).collect()
    found = files.first_in_cache(cache, spark.createDataFrame([("a",), ("c",)], "name string"))
    assert sorted(map(tuple, found.collect())) == [("a", "engine", "2"), ("c", None, None)]


def test_cleared(spark, tmp_path, monkeypatch):
    from sparkvision.sources import package

    monkeypatch.setattr(package, "shared_dir", lambda spark: str(tmp_path / "app"))
    spark.range(3).write.parquet(str(tmp_path / "app" / "x"))
    package.cleared(spark)
    assert list(tmp_path.iterdir()) == []
