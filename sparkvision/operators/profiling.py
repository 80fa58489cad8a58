"""Latency, power and energy samples: summaries, per-layer profiles, time-slice joins, fused layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import first_containing
from .running import cuts_of, running_sums

#: Fixed value of the format: what a compiler adds to the names of layers that it splits.
SUFFIX = r"_myl\d+_\d+$"
PROLOGUE = "__prologue__"
#: The names of metric()'s columns.
METRIC = ("mean", "median", "minimum", "maximum", "std", "ci95")


def metric(x: str) -> list[Column]:
    """Aggregates: mean, median, minimum, maximum, std (sample; 0 for one value) and ci95."""
    std = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    return [F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), std.alias("std"), (1.96 * std / F.sqrt(F.count(x))).alias("ci95")]


def exact_medians(rows: DataFrame, keys: list[str], x: str, cuts: int = 64) -> DataFrame:
    """(keys, median) for groups of any size: a sketch cuts each group's values into ranges, equal values are counted as one,
    and only the ranges that hold the middle are sorted. The cuts decide how much is sorted, never the result. Null values
    do not count; a group with no value, or with a null key, has no row."""
    own = rows.select(*keys, F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL")
    counted = own.groupBy(*keys, "_x").agg(F.count("*").alias("_m"))
    at = F.percentile_approx("_x", [i / cuts for i in range(1, cuts)], 10 * cuts)
    sketch = own.groupBy(*keys).agg(at.alias("_cuts"), F.count("*").alias("_n"))
    part = F.aggregate("_cuts", F.lit(0), lambda k, c: k + F.when(c < F.col("_x"), 1).otherwise(0))
    counted = counted.join(sketch, keys).withColumn("_part", part).drop("_cuts")
    before = lambda *order: F.sum("_m").over(Window.partitionBy(*keys).orderBy(*order)) - F.col("_m")
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    ranges = counted.groupBy(*keys, "_part").agg(F.sum("_m").alias("_m")).withColumn("_before", before("_part"))
    near = counted.join(ranges.select(*keys, "_part", "_before", F.col("_m").alias("_size")), [*keys, "_part"])
    near = near.where((F.col("_before") <= high) & (F.col("_before") + F.col("_size") > low))
    # the ranges that are left follow each other, so what lies before them all is the least of their counts
    first = F.min("_before").over(Window.partitionBy(*keys)) + before("_x")
    near = near.withColumn("_first", first)
    holds = lambda rank: F.max(F.when((F.col("_first") <= rank) & (F.col("_first") + F.col("_m") > rank), F.col("_x")))
    return near.groupBy(*keys).agg(((holds(low) + holds(high)) / 2).alias("median"))


def upper_median(x: str) -> Column:
    """Aggregate: of an even number of values the upper of the middle two."""
    return F.element_at(F.array_sort(F.collect_list(x)), (F.count(x) / 2).cast("int") + 1)


def throughput(mean_s: Column, batch_size: Column) -> Column:
    """Items a second; 0 for a mean of 0."""
    return F.when(mean_s > 0, batch_size / mean_s).otherwise(0.0)


def last_in_iteration(samples: DataFrame) -> DataFrame:
    """Of a layer's samples in one iteration the last counts."""
    w = Window.partitionBy("run_id", "iter", "layer").orderBy(F.desc("seq"))
    return samples.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def layer_profile(samples: DataFrame) -> DataFrame:
    """Per run and layer: mean, median, minimum, maximum, n, and the place of the layer's first sample."""
    own = last_in_iteration(samples)
    out = own.groupBy("run_id", "layer").agg(*metric("ms")[:4], F.count("*").alias("n"), F.min("seq").alias("_first"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("_first"))).drop("_first")


def iteration_totals(samples: DataFrame) -> DataFrame:
    """(run_id, pos, total): the k-th values of all layers together; a layer that missed an iteration moves up."""
    own = last_in_iteration(samples).withColumn("pos", F.row_number().over(Window.partitionBy("run_id", "layer").orderBy("iter")) - 1)
    return own.groupBy("run_id", "pos").agg(F.sum("ms").alias("total"))


#: Sums of samples are exact in this type, so that differences of running sums are.
EXACT = "decimal(38,10)"


def summed(samples: DataFrame, slices: DataFrame, x: str | None = None) -> DataFrame:
    """(t, kind, to_k, to_n, to_s): running sums over the samples' different times (kind 1) and the ends of slices that are looked
    up (kind 0 for t0, 2 for t1): the number of different times, of samples (with `x`: of its values), and with `x` their sum."""
    value = F.sum(F.col(x).cast(EXACT)) if x else F.lit(0)
    times = samples.where("ts IS NOT NULL").groupBy("ts").agg(F.count(x or "*").alias("n"), value.cast(EXACT).alias("s")).select(F.col("ts").alias("t"), F.lit(1).alias("kind"), F.lit(1).alias("k"), "n", "s")
    # a look-up at t0 stands before the samples of that time, one at t1 behind them
    asked = slices.select(F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("t1").alias("t"), F.lit(2).alias("kind")))).alias("a")).select("a.*").where("t IS NOT NULL").distinct()
    both = times.unionByName(asked.select("t", "kind", F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"), F.lit(0).cast(EXACT).alias("s")))
    return running_sums(both, ["t", "kind"], {"to_k": "k", "to_n": "n", "to_s": "s"}, cuts_of(both, "t"))


def looked_up(samples: DataFrame, slices: DataFrame, x: str | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Adds to slices (t0, t1, ...), both ends included: _first and _end, the places of the different sample times inside
    (from _first + 1 to _end), _n, the number of samples (with `x`: of its values), and with `x` _sum. Running sums over the samples' different times
    are looked up twice for a slice: before t0 and at t1; no sample meets a slice. sums: as summed gives them, if they are there already."""
    sums = summed(samples, slices, x) if sums is None else sums
    at = lambda kind, t, name: sums.where(F.col("kind") == kind).select(F.col("t").alias(t), *[F.col(f"to_{c}").alias(f"_{name}_{c}") for c in "kns"])
    own = slices.join(at(0, "t0", "a"), "t0").join(at(2, "t1", "b"), "t1").where("t0 <= t1")
    return own.select(*slices.columns, F.col("_a_k").alias("_first"), F.col("_b_k").alias("_end"), (F.col("_b_n") - F.col("_a_n")).alias("_n"), (F.col("_b_s") - F.col("_a_s")).alias("_sum"))


#: Different times in a block of samples at least and at most.
LEAST, MOST = 8, 4096


def within(samples: DataFrame, slices: DataFrame) -> DataFrame:
    """Interval join, both ends included: samples (ts, ...) with slices (t0, t1, ...). Each slice knows the places of the
    sample times that it holds. Times stand in blocks of consecutive places, of a width for each slice of 1/8 to 1/4 of its
    times (LEAST to MOST), so a slice meets 9 blocks at most, or one for every MOST of its times, and compares at most 1.5 times the
    samples that it holds, or those of 2 * (LEAST - 1) times more, if times have about as many each. Pairs are made by the last join and not shuffled.
    Samples go once into the blocks of each width, a power of two, that a slice has."""
    sums = summed(samples, slices)
    places = sums.where("kind = 1").select(F.col("to_k").alias("_place"), F.col("t").alias("ts"))
    own = looked_up(samples, slices, sums=sums).where("_end > _first").drop("_n", "_sum")
    width = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.pow(2.0, F.floor(F.log2(F.col("_end") - F.col("_first"))) - 2))).cast("long")
    own = own.withColumn("_width", width)
    own = own.withColumn("_block", F.explode(F.sequence(F.floor((F.col("_first") + 1) / F.col("_width")), F.floor(F.col("_end") / F.col("_width")))))
    widths = F.broadcast(own.select("_width").distinct())  # 10 at most
    dealt = samples.join(places, "ts").crossJoin(widths).withColumn("_block", F.floor(F.col("_place") / F.col("_width"))).drop("_place")
    met = own.drop("_first", "_end").join(dealt, ["_width", "_block"]).where("ts >= t0 AND ts <= t1")
    return met.select(*slices.columns, *samples.columns)


def energy_per_slice(samples: DataFrame, slices: DataFrame) -> DataFrame:
    """Per slice with samples: mean power (mW), and energy = power x seconds."""
    own = looked_up(samples, slices, "mw").where("_n > 0")
    power = F.col("_sum").cast("double") / F.col("_n")
    return own.select("slice_id", "t0", "t1", power.alias("power"), F.col("_n").alias("n")).withColumn("energy", F.col("power") * (F.col("t1") - F.col("t0")))


def layer_timeline(samples: DataFrame, start: str = "start") -> DataFrame:
    """Adds t0 and t1: layers follow one another from the iteration's start, by seq."""
    w = Window.partitionBy("run_id", "iter").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("ms").over(w), F.lit(0.0))
    return samples.withColumn("t0", F.col(start) + before / 1000).withColumn("t1", F.col("t0") + F.col("ms") / 1000)


def layer_power(samples: DataFrame, slices: DataFrame) -> DataFrame:
    """Per layer: mean power of the samples in its slices (0 without any) and energy = power x mean ms / 1000."""
    layers = slices.groupBy("layer").agg(F.avg("ms").alias("mean_ms"))
    sums = looked_up(samples, slices, "mw").groupBy("layer").agg(F.sum("_sum").alias("s"), F.sum("_n").alias("n"))
    power = sums.where("n > 0").select("layer", (F.col("s").cast("double") / F.col("n")).alias("power"))
    own = layers.join(power, "layer", "left").withColumn("power", F.coalesce("power", F.lit(0.0)))
    return own.withColumn("energy", F.col("power") * F.col("mean_ms") / 1000)


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, SUFFIX, "")


def chunk_map(profile: DataFrame, group: str = "run_id") -> DataFrame:
    """Per chunk: total ms, and its place by first appearance. A name that starts with / opens or reopens a chunk; others
    add to the one that is open; what comes before any is the prologue. profile: group, pos, name, ms."""
    base = base_name(F.col("name"))
    anchor = F.last(F.when(base.startswith("/"), base), ignorenulls=True).over(Window.partitionBy(group).orderBy("pos"))
    own = profile.withColumn("chunk", F.coalesce(anchor, F.lit(PROLOGUE)))
    out = own.groupBy(group, "chunk").agg(F.sum("ms").alias("ms"), F.min("pos").alias("_first"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_first"))).drop("_first")


def fused_layers(profile: DataFrame, network: DataFrame | None = None) -> DataFrame:
    """(net, layer, fused, n): which profiled name stands for a network layer and for how many. `a + b` fuses its parts;
    `{ForeignNode[a...b]}` all layers between a and b in the network; a name without its suffix one layer of the network.
    Of several the last by pos. profile: net, pos, name; network: net, idx, name."""
    foreign = r"^\{ForeignNode\[(.*)\]\}$"
    kind = F.when(F.col("name").rlike(foreign), "foreign").when(F.col("name").contains(" + "), "sum").otherwise("plain")
    own = profile.withColumn("_kind", kind)
    parts = own.where("_kind = 'sum'").withColumn("_parts", F.split("name", r" \+ "))
    out = parts.select("net", "pos", F.explode("_parts").alias("layer"), F.col("name").alias("fused"), F.size("_parts").alias("n"))
    inner = own.where("_kind = 'foreign'").withColumn("_in", F.regexp_extract("name", foreign, 1)).withColumn("_ends", F.split("_in", r"\.\.\."))
    single = inner.where(F.size("_ends") == 1).select("net", "pos", F.col("_in").alias("layer"), F.col("name").alias("fused"), F.lit(1).alias("n"))
    out = out.unionByName(single)
    if network is not None:
        at = network.select("net", F.col("idx").alias("_i"), F.col("name").alias("_layer"))
        ends = inner.where(F.size("_ends") > 1).select("net", "pos", F.col("name").alias("fused"), F.col("_ends")[0].alias("_a"), F.col("_ends")[1].alias("_b"))
        ends = ends.join(at.select("net", F.col("_layer").alias("_a"), F.col("_i").alias("_lo")), ["net", "_a"]).join(at.select("net", F.col("_layer").alias("_b"), F.col("_i").alias("_hi")), ["net", "_b"])
        spans = ends.where("_lo <= _hi").withColumn("_i", F.explode(F.sequence("_lo", "_hi"))).join(at, ["net", "_i"])
        out = out.unionByName(spans.select("net", "pos", F.col("_layer").alias("layer"), "fused", (F.col("_hi") - F.col("_lo") + 1).cast("int").alias("n")))
        plain = own.where("_kind = 'plain'").withColumn("layer", base_name(F.col("name")))
        plain = plain.join(network.select("net", F.col("name").alias("layer")), ["net", "layer"], "left_semi")
        out = out.unionByName(plain.select("net", "pos", "layer", F.col("name").alias("fused"), F.lit(1).alias("n")))
    last = F.row_number().over(Window.partitionBy("net", "layer").orderBy(F.desc("pos"), F.desc("n")))
    return out.withColumn("_n", last).where("_n = 1").select("net", "layer", "fused", "n")


def profile_iterations(jetson: Column, iterations: Column | None = None) -> Column:
    """Iterations of a profiling run: as asked for; else 10000 where power is sampled as well, and 100 elsewhere."""
    default = F.when(F.coalesce(jetson, F.lit(False)), F.lit(10_000)).otherwise(F.lit(100))
    return default if iterations is None else F.coalesce(iterations, default)


def resolved(layers: DataFrame, values: DataFrame, fused: DataFrame) -> DataFrame:
    """Adds value to layers (net, layer): its own; else its share of the fused one's; else that of the first profiled name
    which contains its name; else null. values: net, pos, name, value."""
    exact = values.select("net", F.col("name").alias("layer"), F.col("value").alias("_exact"))
    share = fused.join(values.select("net", F.col("name").alias("fused"), "value"), ["net", "fused"]).select("net", "layer", (F.col("value") / F.col("n")).alias("_share"))
    own = layers.join(exact, ["net", "layer"], "left").join(share, ["net", "layer"], "left")
    rest = own.where("_exact IS NULL AND _share IS NULL").select("net", "layer")
    holds = first_containing(rest, values.select("net", "name", "pos"))
    held = values.groupBy("net", "pos", "name").agg(F.min("value").alias("_held"))
    holds = holds.join(held, ["net", "pos", "name"]).drop("pos", "name")
    return own.join(holds, ["net", "layer"], "left").withColumn("value", F.coalesce("_exact", "_share", "_held")).drop("_exact", "_share", "_held")


def quantise_speedup(base: DataFrame, quantised: DataFrame, strict: bool = False) -> DataFrame:
    """Per chunk of base: percent of time saved (0 where the base took none), in base's order. strict raises where either
    has a chunk that the other lacks. Both: run_id, chunk, ms, place."""
    left = base.select("run_id", "chunk", F.col("ms").alias("base_ms"), "place")
    right = quantised.select("run_id", "chunk", F.col("ms").alias("quantised_ms"))
    own = left.join(right, ["run_id", "chunk"], "full_outer" if strict else "inner")
    if strict:
        odd = F.col("base_ms").isNull() | F.col("quantised_ms").isNull()
        own = own.withColumn("base_ms", F.when(odd, F.raise_error(F.concat(F.lit("chunk without counterpart: "), "chunk")).cast("double")).otherwise(F.col("base_ms")))
    return own.withColumn("speedup", F.when(F.col("base_ms") > 0, (F.col("base_ms") - F.col("quantised_ms")) / F.col("base_ms") * 100).otherwise(0.0))


#: Bytes of an element by type; others count as 4.
TYPE_BYTES = {"FLOAT": 4, "HALF": 2, "INT8": 1, "INT32": 4, "BOOL": 1, "UINT8": 1}


def tensor_bytes(shape: Column, dtype: Column) -> Column:
    """Elements times bytes; dimensions under 1 count as 1."""
    table = F.create_map(*[F.lit(x) for kv in TYPE_BYTES.items() for x in kv])
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, d: a * F.greatest(F.lit(1), d).cast("long")) * F.coalesce(F.try_element_at(table, dtype), F.lit(4))
