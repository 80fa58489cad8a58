import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvision.sources import video
from sparkvision.streaming import frames, retrieval


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).alias("stream_id"), F.col("id").alias("frame_id"), (F.col("id") * 0.5).alias("value"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    double = lambda d: d.withColumn("value", F.col("value") * 2)
    stream = frames.frames(spark, str(tmp_path / "in"), 2)
    frames.submitted(stream, double, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    frames.submitted(frames.frames(spark, str(tmp_path / "in"), 2), double, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, double(rows).collect()))


def test_fan_in_and_models(spark):
    one = spark.createDataFrame([(1, 10), (1, 11)], "stream_id int, frame_id int")
    two = spark.createDataFrame([(2, 10)], "stream_id int, frame_id int")
    models = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "model_id string, stream_id int")
    got = frames.by_model(frames.fanned_in([one, two]), models)
    assert sorted((r.model_id, r.stream_id, r.frame_id) for r in got.collect()) == [("a", 1, 10), ("a", 1, 11), ("b", 1, 10), ("b", 1, 11), ("b", 2, 10)]


def test_last_timing(spark):
    rows = spark.createDataFrame([("m", 0.0, 1.0), ("m", 2.0, 2.5), ("n", 1.0, 1.0)], "model_id string, t0 double, t1 double")
    assert sorted((r.model_id, r.seconds) for r in frames.last_timing(rows).collect()) == [("m", 0.5), ("n", 0.0)]


START = datetime(2024, 1, 1)
FRAME = "stream_id string, frame_id long, ts timestamp, label string, n int"


def put(spark, folder, rows, k):
    """One file, which is one micro-batch."""
    spark.createDataFrame(rows, FRAME).coalesce(1).write.parquet(f"{folder}/{k:02d}")


def retrieved(spark, folder, check, batches, wait_s=60, late="0 seconds"):
    """Runs what has arrived; appends (batch, stream, frame, arrived, label, n) in the order in which rows leave."""
    stream = spark.readStream.schema(FRAME).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    own = retrieval.in_order(stream, wait_s * 1000, late)
    query = own.writeStream.foreachBatch(lambda df, k: batches.extend((k, *r) for r in df.select("stream_id", "frame_id", "arrived", "label", "n").collect())).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()


def test_frames_come_in_order(spark, tmp_path):
    folder, check, got = str(tmp_path / "in"), str(tmp_path / "check"), []
    at = lambda s, i, sec: (s, i, START + timedelta(seconds=sec), f"{s}{i}", None if i % 2 else i)
    put(spark, folder, [at("a", 1, 1), at("a", 2, 2), at("b", 0, 1), (None, 5, START, "x", 1), ("a", None, START, "x", 1)], 0)
    retrieved(spark, folder, check, got)
    assert [r[1:3] for r in got] == [("b", 0)]  # a0 is missing yet
    put(spark, folder, [at("a", 0, 3), at("a", 5, 4), at("a", 1, 1), at("b", 2, 30)], 1)
    retrieved(spark, folder, check, got)  # a restart
    assert [r[1:3] for r in got if r[1] == "a"] == [("a", 0), ("a", 1), ("a", 2)]
    put(spark, folder, [at("b", 3, 75)], 2)
    retrieved(spark, folder, check, got)
    # the watermark is at 75: a3 and a4 had until 64, b1 has until 90
    assert [r[1:] for r in got if r[1] == "a"] == [("a", 0, True, "a0", 0), ("a", 1, True, "a1", None), ("a", 2, True, "a2", 2), ("a", 3, False, None, None), ("a", 4, False, None, None), ("a", 5, True, "a5", None)]
    assert [r[1:3] for r in got if r[1] == "b"] == [("b", 0)]
    put(spark, folder, [at("a", 4, 76), at("b", 1, 76), at("a", 6, 77)], 3)
    retrieved(spark, folder, check, got)
    assert [r[1:4] for r in got if r[1] == "b"] == [("b", i, True) for i in range(4)]
    assert [r[1:4] for r in got if r[1] == "a"][-1] == ("a", 6, True) and len(got) == 11


def test_shuffled_frames(spark, tmp_path):
    """Whatever the micro-batches, each stream leaves in order, once and whole."""
    rng, folder, got = random.Random(3), str(tmp_path / "in"), []
    rows = [(s, i, START + timedelta(seconds=i), f"{s}{i}", i) for s in "abc" for i in range(40)]
    rng.shuffle(rows)
    for k in range(4):
        put(spark, folder, rows[k::4], k)
        if k % 2:
            retrieved(spark, folder, str(tmp_path / "check"), got, wait_s=1000, late="1 minute")
    for s in "abc":
        assert [r[2:4] for r in got if r[1] == s] == [(i, True) for i in range(40)]
    assert [r[0] for r in got] == sorted(r[0] for r in got)


def test_lockstep(spark, tmp_path):
    with pytest.raises(ValueError):
        retrieval.in_lockstep([], ["a"], ["frame_id"], "1 minute")
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("engine string, " + FRAME).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    one = lambda e: stream.where(F.col("engine") == e).select("stream_id", "frame_id", "ts", F.col("n").alias("result"))
    own = retrieval.in_lockstep([one("x"), one("y"), one("z")], ["x", "y", "z"], ["stream_id", "frame_id"], "1 minute")
    answers = lambda engines, i, sec: [(e, "s", i, START + timedelta(seconds=sec), "", i * 10 + k) for k, e in enumerate(engines)]
    batches = [answers("xyz", 0, 0) + answers("x", 1, 1), answers("y", 1, 20), answers("z", 1, 40) + answers("xy", 2, 41), answers("x", 9, 400) + answers("y", 9, 401), answers("x", 10, 800) + answers("yz", 10, 801), answers("x", 11, 1200) + answers("yz", 11, 1201)]
    held = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "engine string, " + FRAME).coalesce(1).write.parquet(f"{folder}/{k}")
        query = own.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(sum(s.numRowsTotal for s in query.lastProgress.stateOperators))
    got = spark.read.schema(own.schema).parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.select("frame_id", "result_x", "result_y", "result_z").collect()) == [(0, 0, 1, 2), (1, 10, 10, 10), (10, 100, 100, 101), (11, 110, 110, 111)]
    assert held[-1] <= held[2]  # frames 2 and 9, which z never answers, don't stay


def test_frames_of_cameras(spark, tmp_path):
    """More frames and streams come between runs; a restart loses and repeats none."""
    lengths, out = tmp_path / "lengths", str(tmp_path / "out")
    own = video.read_frames(spark, lambda: json.loads(lengths.read_text()), lambda s, i: None if i == 3 else f"{s}{i}".encode(), per_task=2)
    for n in ({"a": 5}, {"a": 5, "b": 1}, {"a": 5, "b": 1}, {"a": 8, "b": 4, "c": 0}):
        lengths.write_text(json.dumps(n))
        own.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r.stream_id, r.frame_id, r.data and bytes(r.data).decode()) for r in spark.read.parquet(out).collect())
        assert got == [(s, i, None if i == 3 else f"{s}{i}") for s, k in sorted(n.items()) for i in range(k)]


def test_models_side_by_side(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), (None, 3)], "model_id string, x long")
    models = {"a": lambda b: b.assign(y=b.x * 10), "b": lambda b: b.assign(y=-b.x)}
    kind = "model_id string, x long, y long"
    got = frames.scored_by_model(rows, models, kind, {"a": lambda b: b.assign(y=b.y + 1)})
    assert sorted(map(tuple, got.collect())) == [("a", 1, 11), ("a", 2, 21), ("b", 1, -1)]
    with pytest.raises(ValueError, match="second step for b"):
        frames.scored_by_model(rows, models, kind, {"a": lambda b: b}, whole=True)
    with pytest.raises(ValueError, match="model for c"):
        frames.scored_by_model(rows, models, kind, {"c": lambda b: b})
    with pytest.raises(Exception, match="no model a"):
        frames.scored_by_model(rows, {"b": models["b"]}, kind).collect()


class Store:
    """A stream's state in memory, which notes what is asked of it."""

    def __init__(self):
        self.asked, self.kept, self.timers = [], {}, set()

    def variable(self, name, schema):
        own = self

        class Variable:
            def get(self):
                own.asked.append(f"get {name}")
                return own.kept.get(name)

            def put(self, value):
                own.kept[name] = value

            update = put

            def clear(self):
                own.kept.pop(name)

        return Variable()

    getValueState = getListState = variable

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_buffer_is_read_only_where_frames_wait():
    """A row of the buffer holds many frames; a stream without waiting frames asks for neither buffer nor timers."""
    state = T.StructType([T.StructField(c, T.LongType()) for c in ("frame_id", "_us", "n")])
    made, store, at = retrieval.Resequencer(["stream_id", *state.names, "arrived"], state, 5000, 0), Store(), datetime(1969, 12, 31, 23, 59, 59, 999_999, timezone.utc)
    made.init(store)
    given = lambda frames, watermark: [tuple(r)[1:] for r in made.handleInputRows(("s",), iter([("s", i, at + timedelta(seconds=i), n) for i, n in frames]), Watermark(watermark))]
    assert given([(1, 7), (0, 6), (1, 8)], 0) == [(0, -1, 6, True), (1, 999_999, 7, True)]
    assert given([(0, 9), (2, None)], 0) == [(2, 1_999_999, None, True)]
    assert store.asked == ["get next", "get next"] and not store.timers
    assert given([(i, i) for i in range(3000, 3, -1)], 0) == []
    assert len(store.kept["waiting"]) == 3 and store.timers == {8999}
    assert given([(4, 0), (2998, 0)], 8998) == [] and store.timers == {8999}
    late = [tuple(r)[1:] for r in made.handleExpiredTimer(("s",), Watermark(8999), Watermark(8999))]
    assert late == [(3, None, None, False), *[(i, i * 1_000_000 - 1, i, True) for i in range(4, 3001)]]
    assert "waiting" not in store.kept and store.kept["next"] == (3001, None)


def test_columns_of_frames_in_order(spark, tmp_path):
    """Columns keep their places and types; microseconds, nulls and times before 1970 stay; a frame that comes twice counts once."""
    kind, folder, got = "n int, ts timestamp, frame_id int, seen timestamp, tags array<string>, stream_id long", str(tmp_path / "in"), []
    at = lambda s: datetime(1970, 1, 1, 0, 0, 1, 1) + timedelta(seconds=s)
    rows = [(1, at(0), 0, at(-9), ["a", None], 5), (None, at(2), 2, None, None, 5), (3, at(2), 2, at(1), [], 5), (4, at(3), 0, at(3), ["b"], None), (5, at(400), 0, None, [], 6)]
    spark.createDataFrame(rows[:2], kind).coalesce(1).write.parquet(f"{folder}/0")
    spark.createDataFrame(rows[2:], kind).coalesce(1).write.parquet(f"{folder}/1")
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    own = retrieval.in_order(stream, 60_000)
    assert own.dtypes == [("n", "int"), ("ts", "timestamp"), ("frame_id", "bigint"), ("seen", "timestamp"), ("tags", "array<string>"), ("stream_id", "bigint"), ("arrived", "boolean")]
    own.writeStream.foreachBatch(lambda df, k: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    first, gap, third = (1, at(0), 0, at(-9), ["a", None], 5, True), (None, None, 1, None, None, 5, False), (None, at(2), 2, None, None, 5, True)
    assert [r for r in got if r[5] == 5] == [first, gap, third]
    assert [r for r in got if r[5] != 5] == [(5, at(400), 0, None, [], 6, True)]
