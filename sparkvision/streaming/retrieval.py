"""Results of frames as a consumer takes them: in the order of their stream, or when every engine has answered.

Both keep state between micro-batches and give it up by the watermark, so what they hold is bounded by how far frames may
be out of order, not by the stream's length. Ordered retrieval keeps its state in Spark's RocksDB store; a stream's buffer
and its rows of one micro-batch are held by one task (maxFilesPerTrigger bounds the latter).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH, MICROSECOND = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)


#: Frames in a row of the buffer's list at most. Spark moves and converts the list row by row, so a row holds many frames, as an
#: array of each column.
PART = 1000


class Resequencer(StatefulProcessor):
    """Per stream the number of the next frame and the frames that came before their turn. A frame is given up when the
    watermark has passed the event time of any later frame by `wait_ms`; it then leaves as a row of nulls.

    Rows are (stream, frame, event time, further columns); they wait and leave with the event time in microseconds. Beside the
    next frame stands when the stream's timer is due: without one nothing waits, and neither buffer nor timers are read."""

    def __init__(self, names: list[str], state: T.StructType, wait_ms: int, first: int):
        self.row, self.state, self.wait_ms, self.first = Row(*names), state, wait_ms, first
        self.nothing = (None,) * (len(state) - 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", T.StructType([T.StructField("frame", T.LongType()), T.StructField("due", T.LongType())]))
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.state]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # a frame that comes twice counts once: the first, or the one that waits already
        new: dict[int, tuple] = {}
        for _, frame, ts, *further in rows:
            new.setdefault(frame, (frame, None if ts is None else (ts - EPOCH) // MICROSECOND, *further))
        yield from self.released(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.released(key, {}, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def released(self, key, new: dict[int, tuple], watermark: int, expired: int | None = None) -> Iterator[Row]:
        stored = self.next.get()
        turn, timer = stored or (self.first, None)
        held = new if timer is None else new | {f[0]: f for part in self.waiting.get() for f in zip(*part, strict=True)}
        order = sorted(f for f in held if f >= turn)
        # of the frames from each on, the least event time: what it waits for is given up by that
        least, soonest = [0] * len(order), None
        for i in reversed(range(len(order))):
            soonest = held[order[i]][1] if soonest is None else min(soonest, held[order[i]][1])
            least[i] = soonest
        i, due = 0, None
        while i < len(order):
            if order[i] > turn:
                due = least[i] // 1000 + self.wait_ms
                if due > watermark:
                    break
                due = None
                for missing in range(turn, order[i]):
                    yield self.row(key[0], missing, *self.nothing, False)
                turn = order[i]
            yield self.row(key[0], *held[turn], True)
            turn, i = turn + 1, i + 1
        if timer not in (None, due, expired):  # Spark deletes the one that has expired
            self.handle.deleteTimer(timer)
        if due is not None:
            kept = [held[f] for f in order[i:]]
            self.waiting.put([tuple(zip(*kept[k : k + PART], strict=True)) for k in range(0, len(kept), PART)])
            if due != timer:
                self.handle.registerTimer(due)
        elif timer is not None:
            self.waiting.clear()
        if (turn, due) != stored:
            self.next.update((turn, due))

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, wait_ms: int, late: str = "0 seconds", stream_col: str = "stream_id", frame_col: str = "frame_id", ts_col: str = "ts", first: int = 0) -> DataFrame:
    """The rows of a stream by (stream_col, frame_col), each stream's frames in order and without gaps: those that don't come
    in time are there as nulls, with `arrived` false. Frames are numbered from `first`; one that comes after it was given up,
    or a second time, is left out, and so is a row without stream or frame. `late` is the watermark's delay."""
    stream.sparkSession.conf.set(STORE, ROCKS_DB)
    own = stream.where(F.col(stream_col).isNotNull() & F.col(frame_col).isNotNull()).withColumn(frame_col, F.col(frame_col).cast("long"))
    kinds = {f.name: f.dataType for f in own.schema}
    further = [c for c in kinds if c not in (stream_col, frame_col, ts_col)]
    state = T.StructType([T.StructField(frame_col, T.LongType()), T.StructField("_us", T.LongType()), *[T.StructField(c, kinds[c]) for c in further]])
    given = T.StructType([T.StructField(stream_col, kinds[stream_col]), *state, T.StructField("arrived", T.BooleanType())])
    own = own.withWatermark(ts_col, late).select(stream_col, frame_col, ts_col, *further)
    out = own.groupBy(stream_col).transformWithState(Resequencer(given.names, state, wait_ms, first), given, "Append", "EventTime")
    return out.withColumn(ts_col, F.timestamp_micros("_us").cast(kinds[ts_col])).select(*kinds, "arrived")


def in_lockstep(results: list[DataFrame], engines: list[str], keys: list[str], within: str, late: str = "0 seconds", ts_col: str = "ts", result_col: str = "result") -> DataFrame:
    """(keys, ts of the first engine, result_<engine>, ...): a frame leaves when every engine has answered, within the time
    `within` of the first engine's answer. By the watermark, which allows for answers that are `late`, Spark drops what can no
    longer meet an answer. As many streams of results (keys, ts, result) as engines are asked for."""
    if len(results) != len(engines):
        raise ValueError(f"{len(results)} streams of results for {len(engines)} engines")
    out = None
    for k, (r, engine) in enumerate(zip(results, engines, strict=True)):
        one = r.select(*[F.col(c).alias(f"{c}_{k}") for c in keys], F.col(ts_col).alias(f"_ts_{k}"), F.col(result_col).alias(f"result_{engine}")).withWatermark(f"_ts_{k}", late)
        if out is None:
            out = one
            continue
        same = [F.col(f"{c}_0") == F.col(f"{c}_{k}") for c in keys]
        near = F.expr(f"_ts_{k} >= _ts_0 - INTERVAL {within} AND _ts_{k} <= _ts_0 + INTERVAL {within}")
        for c in [*same[1:], near]:
            same[0] = same[0] & c
        out = out.join(one, same[0], "inner")
    return out.select(*[F.col(f"{c}_0").alias(c) for c in keys], F.col("_ts_0").alias(ts_col), *[f"result_{e}" for e in engines])
