"""Network layers: islands of compatible layers, placement, costs, schedules, and cuts of the graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent_difference

MIB = float(1 << 20)
#: Fixed values of the cost model: what a layer costs that was not measured, and the share of its GPU cost on the DLA.
MISSING_GPU_MS, MISSING_GPU_MJ, DLA_TIME, DLA_ENERGY = 0.01, 0.001, 1.5, 0.5
#: Base and per-MiB time (ms) and energy (mJ) of a change of processor.
CHANGE_MS, CHANGE_MS_MB, CHANGE_MJ, CHANGE_MJ_MB = 0.1, 0.05, 0.01, 0.005


def islands(layers: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """(net, chunk, first, last, n, compat): runs of layers with equal compatibility. Of the networks (net) those without any
    layer have one empty run, from 0 to -1, which isn't compatible."""
    w = Window.partitionBy("net").orderBy("idx")
    change = F.coalesce((F.col("compat") != F.lag("compat").over(w)).cast("int"), F.lit(0))
    own = layers.withColumn("_change", change).withColumn("chunk", F.sum("_change").over(w))
    out = own.groupBy("net", "chunk").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"), F.first("compat").alias("compat"))
    if networks is None:
        return out
    empty = {"chunk": F.lit(0).cast("long"), "first": F.lit(0), "last": F.lit(-1), "n": F.lit(0).cast("long"), "compat": F.lit(False)}
    return networks.select("net").distinct().join(out, "net", "left").select("net", *[F.coalesce(c, v).alias(c) for c, v in empty.items()])


def selected(chunks: DataFrame, max_chunks: int = 1, min_layers: int = 20) -> DataFrame:
    """Of each network's compatible chunks with enough layers the longest, of equal ones the first; all if max_chunks <= 0."""
    own = chunks.where(F.col("compat") & (F.col("n") >= min_layers))
    if max_chunks <= 0:
        return own
    rank = F.row_number().over(Window.partitionBy("net").orderBy(F.desc("n"), "chunk"))
    return own.withColumn("_rank", rank).where(F.col("_rank") <= max_chunks).drop("_rank")


def assigned(layers: DataFrame, chosen: DataFrame, plain_types: tuple[str, ...] = ("CONSTANT", "SHUFFLE")) -> DataFrame:
    """Adds precision and device: GPU and HALF, no precision for plain types and tiles; chosen chunks are INT8 on the DLA."""
    spans = chosen.select("net", "first", "last")
    own = layers.alias("l").join(spans.alias("s"), (F.col("l.net") == F.col("s.net")) & F.col("idx").between(F.col("first"), F.col("last")), "left").select("l.*", F.col("first").isNotNull().alias("_in"))
    plain = F.col("type").isin(*plain_types) | F.lower("name").contains("tile")
    precision = F.when(F.col("_in"), "INT8").when(plain, F.lit(None)).otherwise("HALF")
    return own.withColumn("precision", precision).withColumn("device", F.when(F.col("_in"), "DLA").otherwise("GPU")).drop("_in")


def energy_shares(layers: DataFrame, total_energy: Column) -> DataFrame:
    """Adds energy: the total by each layer's share of the network's mean time; 0 where there is no time."""
    whole = F.sum("mean").over(Window.partitionBy("net"))
    return layers.withColumn("energy", F.when(whole > 0, total_energy * F.col("mean") / whole).otherwise(0.0))


def dla_costs(layers: DataFrame) -> DataFrame:
    """Adds gpu_ms, gpu_mj, dla_ms, dla_mj. layers: net, idx, gpu_time, gpu_energy (null if not measured), blob (the fused
    name, or null), blob_time, blob_energy, exact_time, exact_energy (the layer's own, or null). A blob's cost is dealt out
    by the share of GPU time (energy) in it, evenly if that is 0."""
    own = layers.withColumn("gpu_ms", F.coalesce("gpu_time", F.lit(MISSING_GPU_MS))).withColumn("gpu_mj", F.coalesce("gpu_energy", F.lit(MISSING_GPU_MJ)))
    w = Window.partitionBy("net", "blob")

    def share(gpu: str, blob: str) -> Column:
        whole = F.sum(gpu).over(w)
        return F.when(F.col("blob").isNotNull(), F.when(whole > 0, F.col(blob) * F.col(gpu) / whole).otherwise(F.col(blob) / F.count("*").over(w)))

    own = own.withColumn("dla_ms", F.coalesce(F.col("exact_time"), share("gpu_ms", "blob_time"), F.col("gpu_ms") * DLA_TIME))
    return own.withColumn("dla_mj", F.coalesce(F.col("exact_energy"), share("gpu_mj", "blob_energy"), F.col("gpu_mj") * DLA_ENERGY))


def schedule_cost(assignment: DataFrame) -> DataFrame:
    """Per schedule: time, energy and transitions. assignment: schedule_id, idx, proc (G or D), gpu_ms, gpu_mj, dla_ms,
    dla_mj, size (bytes of the layer's output). A change of processor costs by the output of the layer before."""
    w = Window.partitionBy("schedule_id").orderBy("idx")
    own = assignment.withColumn("_change", F.lag("proc").over(w) != F.col("proc")).withColumn("_mb", F.lag("size").over(w) / MIB)
    pick = lambda unit: F.when(F.col("proc") == "D", F.coalesce(f"dla_{unit}", f"gpu_{unit}")).otherwise(F.col(f"gpu_{unit}"))
    extra = lambda base, each: F.when(F.col("_change"), base + F.col("_mb") * each).otherwise(0.0)
    return own.groupBy("schedule_id").agg(F.sum(pick("ms") + extra(CHANGE_MS, CHANGE_MS_MB)).alias("time_ms"), F.sum(pick("mj") + extra(CHANGE_MJ, CHANGE_MJ_MB)).alias("energy_mj"), F.sum(F.coalesce(F.col("_change").cast("int"), F.lit(0))).alias("transitions"))


def solved_one_change(layers: DataFrame, energy_share: float = 0.8) -> DataFrame:
    """Per network the fastest schedule with at most one change of processor whose energy is at most energy_share of all-GPU;
    all-GPU if there is none. Candidates are the cut points; their costs are prefix sums. Ties: energy, then the cut.
    layers: net, idx, gpu_ms, gpu_mj, dla_ms, dla_mj, size, compat. Gives net, cut (layers before it run on the first
    processor), first_proc, time_ms, energy_mj."""
    up = Window.partitionBy("net").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy("net")
    own = layers.withColumn("_bad", (~F.col("compat")).cast("int"))
    sums = {f"{c}_to": F.sum(c).over(up) for c in ("gpu_ms", "gpu_mj", "dla_ms", "dla_mj", "_bad")} | {f"{c}_all": F.sum(c).over(all_) for c in ("gpu_ms", "gpu_mj", "dla_ms", "dla_mj", "_bad")}
    own = own.withColumns(sums).withColumn("_last", F.col("idx") == F.max("idx").over(all_)).withColumn("_mb", F.col("size") / MIB)

    def cost(unit: str, a: str, b: str, base: float, each: float) -> Column:
        change = F.when(F.col("_last"), 0.0).otherwise(base + F.col("_mb") * each)
        return F.col(f"{a}_{unit}_to") + F.col(f"{b}_{unit}_all") - F.col(f"{b}_{unit}_to") + change

    def option(a: str, b: str, proc: str, bad: Column) -> Column:
        return F.struct(F.lit(proc).alias("first_proc"), cost("ms", a, b, CHANGE_MS, CHANGE_MS_MB).alias("time_ms"), cost("mj", a, b, CHANGE_MJ, CHANGE_MJ_MB).alias("energy_mj"), (bad == 0).alias("ok"))

    tried = own.select("net", (F.col("idx") + 1).alias("cut"), "gpu_ms_all", "gpu_mj_all", F.explode(F.array(option("gpu", "dla", "G", F.col("_bad_all") - F.col("_bad_to")), option("dla", "gpu", "D", F.col("_bad_to")))).alias("o"))
    tried = tried.select("net", "cut", "gpu_ms_all", "gpu_mj_all", "o.*").withColumn("ok", F.col("ok") & (F.round("energy_mj", 9) <= F.round(energy_share * F.col("gpu_mj_all"), 9)))
    best = tried.where("ok").groupBy("net").agg(F.min(F.struct(F.round("time_ms", 9).alias("t"), F.round("energy_mj", 9).alias("e"), "cut", "first_proc")).alias("b"))
    plain = own.groupBy("net").agg(F.max("gpu_ms_all").alias("gpu_ms"), F.max("gpu_mj_all").alias("gpu_mj"), (F.max("idx") + 1).alias("n"))
    out = plain.join(best, "net", "left")
    return out.select("net", F.coalesce("b.cut", "n").alias("cut"), F.coalesce("b.first_proc", F.lit("G")).alias("first_proc"), F.coalesce("b.t", "gpu_ms").alias("time_ms"), F.coalesce("b.e", "gpu_mj").alias("energy_mj"))


def solved(layers: DataFrame, energy_share: float = 0.8, max_transitions: int = 1) -> DataFrame:
    """As solved_one_change for any number of changes: per network a frontier of (time, energy, places of the changes) by
    processor and number of changes so far, in one task a network. An entry is as long as its changes, not as the network.
    Gives net, procs (a letter a layer), time_ms, energy_mj, transitions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        budget = energy_share * pdf.gpu_mj.sum()
        states: dict[tuple[str, int], list[tuple[float, float, tuple[int, ...]]]] = {}
        before = 0.0
        for i, r in enumerate(pdf.itertuples()):
            new: dict[tuple[str, int], list[tuple[float, float, tuple[int, ...]]]] = {}
            for proc in "GD" if r.compat else "G":
                t, e = (r.gpu_ms, r.gpu_mj) if proc == "G" else (r.dla_ms, r.dla_mj)
                if not i:
                    new[proc, 0] = [(t, e, ())]
                    continue
                for (last, k), front in states.items():
                    changed = last != proc
                    if k + changed > max_transitions:
                        continue
                    dt, de = (t + CHANGE_MS + before * CHANGE_MS_MB, e + CHANGE_MJ + before * CHANGE_MJ_MB) if changed else (t, e)
                    new.setdefault((proc, k + changed), []).extend((a + dt, b + de, cuts + (i,) * changed) for a, b, cuts in front if b + de <= budget + 1e-9)
            for key, front in new.items():
                best, kept = float("inf"), []
                for x in sorted(front):
                    if x[1] < best - 1e-12:
                        kept.append(x)
                        best = x[1]
                new[key] = kept
            states, before = new, r.size / MIB

        def letters(proc: str, cuts: tuple[int, ...]) -> str:
            edges, swap = [0, *cuts, len(pdf)], len(cuts) % 2 == 1
            first = "GD"[(proc == "D") != swap]
            other = "DG"[first == "D"]
            return "".join((first, other)[j % 2] * (b - a) for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))

        ends = [(round(t, 9), round(e, 9), proc, cuts, k) for (proc, k), front in states.items() for t, e, cuts in front if e <= budget + 1e-9]
        least = min((x[:2] for x in ends), default=None)
        t, e, s, k = min((*x[:2], letters(x[2], x[3]), x[4]) for x in ends if x[:2] == least) if ends else (pdf.gpu_ms.sum(), pdf.gpu_mj.sum(), "G" * len(pdf), 0)
        return pd.DataFrame({"net": [pdf.net.iloc[0]], "procs": [s], "time_ms": [t], "energy_mj": [e], "transitions": [k]})

    return layers.select("net", "idx", "gpu_ms", "gpu_mj", "dla_ms", "dla_mj", "size", "compat").groupBy("net").applyInPandas(run, "net string, procs string, time_ms double, energy_mj double, transitions int")


def compared_schedules(chosen: DataFrame, layers: DataFrame) -> DataFrame:
    """Adds to chosen (net, time_ms, energy_mj) the throughput and power of a schedule and, in percent, how its time and
    energy differ from those of all layers on the GPU and of all that can be on the DLA; 0 where there is none to divide by.
    layers: as for solved_one_change."""
    on_dla = schedule_cost(layers.withColumn("schedule_id", F.col("net")).withColumn("proc", F.when(F.col("compat"), "D").otherwise("G")))
    # nine digits, as solved schedules have: the same schedule summed in another order differs by nothing
    on_dla = on_dla.select(F.col("schedule_id").alias("net"), F.round("time_ms", 9).alias("_dla_ms"), F.round("energy_mj", 9).alias("_dla_mj"))
    on_gpu = layers.groupBy("net").agg(F.round(F.sum("gpu_ms"), 9).alias("_gpu_ms"), F.round(F.sum("gpu_mj"), 9).alias("_gpu_mj"))
    own = chosen.select("net", F.round("time_ms", 9).alias("time_ms"), F.round("energy_mj", 9).alias("energy_mj")).join(on_gpu, "net").join(on_dla, "net")
    some = F.col("time_ms") > 0
    own = own.withColumn("fps", F.when(some, 1000 / F.col("time_ms")).otherwise(0.0)).withColumn("watts", F.when(some, F.col("energy_mj") / F.col("time_ms")).otherwise(0.0))
    for device in ("gpu", "dla"):
        own = own.withColumn(f"time_vs_{device}", percent_difference(F.col("time_ms"), F.col(f"_{device}_ms"))).withColumn(f"energy_vs_{device}", percent_difference(F.col("energy_mj"), F.col(f"_{device}_mj")))
    return own.drop("_gpu_ms", "_gpu_mj", "_dla_ms", "_dla_mj")


def subgraph_ports(io: DataFrame, start: int, end: int) -> DataFrame:
    """(net, tensor, port): inputs and outputs of nodes start..end. io: net, node, tensor, dir (in or out). Inputs are
    consumed but not produced inside; outputs are produced inside and consumed later, or all produced if none is."""
    if start < 0 or end < start:
        raise ValueError("a subgraph needs 0 <= start <= end")
    inside = io.where(F.col("node").between(start, end))
    used, made = (inside.where(F.col("dir") == d).select("net", "tensor").distinct() for d in ("in", "out"))
    later = io.where((F.col("node") > end) & (F.col("dir") == "in")).select("net", "tensor").distinct()
    ins = used.join(made, ["net", "tensor"], "left_anti").withColumn("port", F.lit("input"))
    outs = made.join(later.withColumn("_later", F.lit(True)), ["net", "tensor"], "left")
    any_ = F.max("_later").over(Window.partitionBy("net"))
    outs = outs.withColumn("_any", any_).where("_later OR _any IS NULL").select("net", "tensor", F.lit("output").alias("port"))
    return ins.unionByName(outs)


def split_ports(io: DataFrame, ranges: DataFrame) -> DataFrame:
    """(net, part, tensor, port): as subgraph_ports for all parts of all networks at once. ranges: net, part, first, last (as
    split_ranges gives them). Each tensor knows the last part that consumes it, so no part is compared with another."""
    nodes = ranges.select("net", "part", F.explode(F.sequence("first", "last")).alias("node"))
    at = io.join(nodes, ["net", "node"]).groupBy("net", "tensor", "part").agg(F.bool_or(F.col("dir") == "in").alias("_used"), F.bool_or(F.col("dir") == "out").alias("_made"))
    last = F.max(F.when(F.col("_used"), F.col("part"))).over(Window.partitionBy("net", "tensor"))
    at = at.withColumn("_later", F.col("_made") & F.coalesce(last > F.col("part"), F.lit(False)))
    at = at.withColumn("_any", F.bool_or("_later").over(Window.partitionBy("net", "part")))
    output = F.col("_made") & (F.col("_later") | ~F.col("_any"))
    ports = F.array_compact(F.array(F.when(F.col("_used") & ~F.col("_made"), "input"), F.when(output, "output")))
    return at.select("net", "part", "tensor", F.explode(ports).alias("port"))


def split_ranges(cuts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(net, part, first, last): the nodes up to and including each cut, and the rest. cuts: net, idx; sizes: net, n. A cut at
    the last node leaves an empty rest, which is an error."""
    w = Window.partitionBy("net").orderBy("idx")
    ends = cuts.select("net", "idx").unionByName(sizes.select("net", (F.col("n") - 1).alias("idx")))
    own = ends.select("net", F.col("idx").alias("last"), (F.coalesce(F.lag("idx").over(w), F.lit(-1)) + 1).alias("first"), (F.row_number().over(w) - 1).alias("part"))
    bad = F.when(F.col("first") > F.col("last"), F.raise_error(F.lit("a split at the last node leaves nothing"))).otherwise(F.col("first"))
    return own.select("net", "part", bad.cast("int").alias("first"), "last")


def static_shape(shape: Column) -> Column:
    """Dimensions that are not positive become 1."""
    return F.transform(shape, lambda d: F.when(d > 0, d).otherwise(F.lit(1).cast("int")))


def kept_in_float(name: Column) -> Column:
    """Layers that lose too much in half precision."""
    return F.lower(name).rlike("reducemean|downsample")


def consistent_flags(flags: DataFrame) -> DataFrame:
    """Of conflicting precision flags one goes: fp16 beside int8 or fp8, then int8 beside fp8."""
    fp16 = F.col("fp16") & ~F.col("int8") & ~F.col("fp8")
    return flags.withColumn("fp16", fp16).withColumn("int8", F.col("int8") & ~F.col("fp8"))


#: The range of optimisation levels, and how the default device may be written.
OPTIMISATION_LEVELS, DEVICES = (0, 5), ("gpu", "GPU", "dla", "DLA")


def build_options(options: DataFrame) -> DataFrame:
    """Adds what follows from build options, and the rules that they break, as `broken` (stop the build) and `doubtful`.
    options: optimisation_level int, device string, fp16, fp8, int8, direct_io boolean, input_formats, output_formats
    array<string> (tensors with a format; null for none), inputs, outputs array<string> (the network's), has_calibration
    boolean. A null flag is off. fp16 is on with any lower precision, direct_io with any format."""
    low, high = OPTIMISATION_LEVELS
    none = F.array().cast("array<string>")
    on = {c: F.coalesce(c, F.lit(False)) for c in ("fp16", "fp8", "int8", "direct_io", "has_calibration")}
    unknown = lambda asked, there: F.size(F.array_except(F.coalesce(asked, none), there)) > 0
    rules = {
        "optimisation_level": ~F.col("optimisation_level").between(low, high),
        "device": ~F.col("device").isin(*DEVICES),
        "input_formats": unknown("input_formats", "inputs"),
        "output_formats": unknown("output_formats", "outputs"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in rules.items()]))
    doubtful = F.array_compact(F.array(F.when(on["int8"] & ~on["has_calibration"], F.lit("int8_without_calibration"))))
    formats = F.col("input_formats").isNotNull() | F.col("output_formats").isNotNull()
    flags = {"fp16": on["fp16"] | on["fp8"] | on["int8"], "fp8": on["fp8"], "int8": on["int8"], "direct_io": on["direct_io"] | formats}
    return options.withColumns({"broken": broken, "doubtful": doubtful} | flags | {"device": F.lower("device")})
