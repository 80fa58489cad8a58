"""Operator 9: packing by minimum bin slack.

A bin takes the longest piece that is left; a subset-sum over the lengths still available, held as the bits of one
integer, finds the fullest feasible rest; the combination is removed. Lengths are at most the capacity, so what the
search needs to know of the corpus is a table of at most `capacity` counts. A combination is applied as often as its
lengths last, which is what bin after bin would choose, so the plan stays small however many bins it stands for. Spark
then numbers the pieces of each length and looks their places up in the plan.

Null text counts as empty. A document that is empty has one piece: the closing id alone. Repeated rows are packed each
for itself, with or without an id. Pieces of one length are numbered by salt, id (null first), piece and checksum; pieces
equal in all of these may change places, which changes no sequence's lengths. Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoded
from .scratch import parts, reused

CLOSING_ID = 1


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32."""
    kept = docs.select(id_col, text_col)
    schema = T.StructType([kept.schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for rows, each in encoded(batches, path, text_col):
            sizes = np.array([len(x) + 1 for x in each])
            number = -(-sizes // capacity)
            row = np.repeat(np.arange(len(each)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            closed = [np.append(x, CLOSING_ID).astype("<u4") for x in each]
            crc = [zlib.crc32(closed[r][s : s + n]) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with their number, whose sum comes nearest to room without passing it; long ones are tried first."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted(available, reverse=True):
        left = min(available[length], room // length)
        size = 1
        while left > 0:
            n = min(size, left)
            steps.append((length, n, reach))
            reach |= reach << length * n & mask
            left -= n
            size *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + n
            total -= length * n
    return out


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first number, past the last, first bin, pieces a bin, place in the bin), and the number of bins."""
    left, used, rows, bins = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if k <= capacity - longest and v > (k == longest)}
        take = fullest(rest, capacity - longest) if rest else {}
        take[longest] = take.get(longest, 0) + 1
        times = min(left[k] // n for k, n in take.items())
        place = 0
        for k in sorted(take, reverse=True):
            rows.append((k, used[k], used[k] + times * take[k], bins, take[k], place))
            place += k * take[k]
            used[k] += times * take[k]
            left[k] -= times * take[k]
            if not left[k]:
                del left[k]
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6), bins


def pack(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset. Every sequence holds at most `capacity`
    tokens, gapless from 0. The numbering within a length is spread over salts, so no length meets in one task."""
    spark = docs.sparkSession
    cut = pieces(docs, path, capacity, id_col, text_col)
    # by place, as ids and texts may all be equal
    salted = reused(cut.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts(spark))).cast("int")))
    counts = reused(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")))
    # at most `capacity` lengths reach the driver
    table, _ = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32"))
    numbered = salted.withColumn("_number", number).join(offsets, ["length", "_salt"])
    numbered = numbered.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_number") - 1).alias("_number"))
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        key = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, n = (np.asarray(b.column(i)) for i in (3, 5))
            row = table[np.searchsorted(key, length << 44 | n, side="right") - 1]
            at = n - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + at // np.maximum(row[:, 4], 1)), pa.array(row[:, 5] + at % np.maximum(row[:, 4], 1) * length)], names=schema.names)

    return numbered.mapInArrow(place, schema)
