"""Names that contain other names: one pass of an automaton over the longer ones.

The layers that a network looks for make up one automaton, through which each of its profiled names runs once, whatever the
number of layers and however short they are. A network's names are dealt out to as many tasks as they fill, each of which
builds the network's automaton again; a network with more than PATTERNS layers has them dealt out as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names a task takes of one network, and layers in one automaton.
NAMES, PATTERNS = 100_000, 100_000
ROW = "net string, part long, task long, name boolean, text string, pos long"
FOUND = "net string, layer string, pos long, name string"


def dealt(rows: DataFrame, each: int) -> DataFrame:
    """(net, n): in how many parts a network's rows go."""
    return rows.groupBy("net").agg(F.ceil(F.count("*") / each).alias("n"))


def first_containing(layers: DataFrame, names: DataFrame, each: int = NAMES, patterns: int = PATTERNS) -> DataFrame:
    """(net, layer, pos, name): of each layer the first by (pos, name) of the names of its network that contain it; none where
    there is no such name. layers: net, layer; names: net, name, pos. Rows with a null among these count as not there."""
    asked = layers.where("net IS NOT NULL AND layer IS NOT NULL").select("net", "layer").distinct()
    own = names.where("net IS NOT NULL AND name IS NOT NULL AND pos IS NOT NULL").select("net", "name", F.col("pos").cast("long").alias("pos"))
    parts, tasks = dealt(asked, patterns).withColumnRenamed("n", "n_parts"), dealt(own, each).withColumnRenamed("n", "n_tasks")
    sizes = parts.join(tasks, "net")
    none = F.lit(None)
    left = asked.join(sizes, "net").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tasks") - 1)))
    left = left.select("net", F.pmod(F.xxhash64("layer"), "n_parts").alias("part"), "task", F.lit(False).alias("name"), F.col("layer").alias("text"), none.cast("long").alias("pos"))
    right = own.join(sizes, "net").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    right = right.select("net", "part", F.pmod(F.xxhash64("name", "pos"), "n_tasks").alias("task"), F.lit(True).alias("name"), F.col("name").alias("text"), "pos")
    both = left.unionByName(right).repartition("net", "part", "task").sortWithinPartitions("net", "part", "task", "name").mapInArrow(searched, FOUND)
    return both.groupBy("net", "layer").agg(F.min(F.struct("pos", "name")).alias("f")).select("net", "layer", "f.pos", "f.name")


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Layers come before the names that they are looked for in; gives the least place of each that was found."""
    at, automaton, full, every = None, None, False, False
    least: dict[str, tuple[int, str]] = {}

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(least), pa.string()), pa.array(list(least), pa.string()), pa.array([p for p, _ in least.values()], pa.int64()), pa.array([n for _, n in least.values()], pa.string())], names=["net", "layer", "pos", "name"])

    for batch in batches:
        for net, part, task, name, text, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (net, part, task) != at:
                if least:
                    yield found()
                at, automaton, least, full, every = (net, part, task), ahocorasick.Automaton(), {}, False, False
            if not name:
                if text:
                    automaton.add_word(text, text)
                every |= not text
                continue
            if not full:
                automaton.make_automaton()
                full = True
            if every:  # an empty name is in all
                least[""] = min((pos, text), least.get("", (pos, text)))
            if len(automaton):
                for _, layer in automaton.iter(text):
                    if layer not in least or (pos, text) < least[layer]:
                        least[layer] = (pos, text)
    if least:
        yield found()
