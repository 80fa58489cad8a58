"""Schedules with several changes of processor, found by joining segments of a network.

A segment is a run of layers, known by what its schedules can do: for the processors of its first and last layer and the
number of changes inside, the schedules of which no other has both less time and less energy. Two neighbours join into one,
and the joining is associative, so segments of BLOCK layers are made at once, each by itself, from small ones in which all places
of changes are tried, and FAN neighbours join in each round: log(layers) rounds instead of one task that walks a whole network.

What cannot be part of an answer is dropped early: schedules that leave the rest of the network, at its least energy, no
room in the budget, and those whose time lies above the best schedule with one change even if the rest costs no more than in
the Lagrangian relaxation of the budget, whose multiplier is where layers moved by rising time per saved energy meet it.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scheduling import CHANGE_MJ, CHANGE_MJ_MB, CHANGE_MS, CHANGE_MS_MB, MIB, solved_one_change

BLOCK, FAN = 1024, 8
#: Pairs of schedules that a task joins at once.
PAIRS = 1 << 20
#: Places of changes that are tried one by one in the smallest segments, of which a segment has as many layers as this allows.
TRIED = 4500
SLACK = 1e-9
SEGMENT = "net string, seg long, start long, end long, first string, last string, changes int, ms double, mj double, cuts array<int>, mb double, least double, relaxed double, budget double, bound double, multiplier double, all_least double, all_relaxed double"
FACTS = ("net", "budget", "bound", "multiplier", "all_least", "all_relaxed")


def relaxed(layers: DataFrame, energy_share: float) -> DataFrame:
    """Adds to layers budget (of the network), multiplier, and of each layer least (energy) and relaxed (time plus multiplier x
    energy, on the better processor), with the network's sums of both. DLA only where compatible."""
    dla = F.col("compat") & F.col("dla_ms").isNotNull() & F.col("dla_mj").isNotNull()
    saved, slower = F.when(dla, F.col("gpu_mj") - F.col("dla_mj")).otherwise(0.0), F.when(dla, F.col("dla_ms") - F.col("gpu_ms")).otherwise(0.0)
    net = Window.partitionBy("net")
    own = layers.withColumns({"_saved": saved, "_slower": slower, "budget": energy_share * F.sum("gpu_mj").over(net)})
    # layers move by rising price; those that save energy and time are moved anyway
    own = own.withColumn("_price", F.when(F.col("_saved") > 0, F.greatest(F.col("_slower") / F.col("_saved"), F.lit(0.0))))
    moved = F.sum(F.when(F.col("_price").isNotNull(), F.col("_saved")).otherwise(0.0)).over(net.orderBy(F.asc_nulls_last("_price"), "idx"))
    short = F.sum("gpu_mj").over(net) - F.col("budget")
    own = own.withColumn("multiplier", F.coalesce(F.min(F.when((moved >= short) & F.col("_price").isNotNull(), F.col("_price"))).over(net), F.max("_price").over(net), F.lit(0.0)))
    cost = lambda p: F.col(f"{p}_ms") + F.col("multiplier") * F.col(f"{p}_mj")
    best = lambda g, d: F.when(dla, F.least(g, d)).otherwise(g)
    own = own.withColumns({"least": best(F.col("gpu_mj"), F.col("dla_mj")), "relaxed": best(cost("gpu"), cost("dla"))})
    return own.withColumns({"all_least": F.sum("least").over(net), "all_relaxed": F.sum("relaxed").over(net)}).drop("_saved", "_slower", "_price")


class Segment:
    """fronts: (first, last, changes) to (times, energies, places of the changes)."""

    def __init__(self, start: int, end: int, mb: float, least: float, relaxed: float, fronts: dict):
        self.start, self.end, self.mb, self.least, self.relaxed, self.fronts = start, end, mb, least, relaxed, fronts


def front(ms: np.ndarray, mj: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of schedules those of which no other has less of both."""
    order = np.lexsort((mj, ms))
    e = mj[order]
    best = np.minimum.accumulate(np.append(np.inf, e))[:-1]
    keep = order[e < best - 1e-12]
    return ms[keep], mj[keep], cuts[keep]


def possible(ms, mj, rest_least: float, rest_relaxed: float, net) -> np.ndarray:
    room = mj + rest_least <= net.budget + SLACK
    return room & (ms + net.multiplier * mj + rest_relaxed - net.multiplier * net.budget <= net.bound + SLACK)


def joined(a: Segment, b: Segment, net, most: int) -> Segment:
    """The schedules of two neighbours as one segment's."""
    least, relaxed_ = a.least + b.least, a.relaxed + b.relaxed
    rest = net.all_least - least, net.all_relaxed - relaxed_
    found: dict[tuple, list] = {}
    for (p, q, k), (t1, e1, c1) in a.fronts.items():
        for (r, s, m), (t2, e2, c2) in b.fronts.items():
            changed = q != r
            if k + m + changed > most:
                continue
            dt, de = (CHANGE_MS + a.mb * CHANGE_MS_MB, CHANGE_MJ + a.mb * CHANGE_MJ_MB) if changed else (0.0, 0.0)
            step = max(1, PAIRS // len(t2))
            for i in range(0, len(t1), step):
                t, e = t1[i : i + step, None] + t2 + dt, e1[i : i + step, None] + e2 + de
                x, y = np.nonzero(possible(t, e, *rest, net))
                if not len(x):
                    continue
                cuts = np.full((len(x), most), -1, np.int32)
                cuts[:, :k] = c1[i + x, :k]
                cuts[:, k : k + changed] = b.start
                cuts[:, k + changed : k + changed + m] = c2[y, :m]
                found.setdefault((p, s, k + m + changed), []).append(front(t[x, y], e[x, y], cuts))
    return Segment(a.start, b.end, b.mb, least, relaxed_, best_of(found))


def best_of(found: dict[tuple, list]) -> dict:
    """The fronts of what was found, without schedules that one of fewer changes equals or beats."""
    fronts = {}
    for key in sorted(found, key=lambda f: f[2]):  # fewer changes leave more to the rest, so they rule out more of them
        own = front(*map(np.concatenate, zip(*found[key], strict=True)))
        for k in range(key[2]):
            t, e, _ = fronts.get((*key[:2], k), (np.zeros(0),) * 3)
            if len(t):
                at = np.searchsorted(t, own[0], side="right") - 1
                worse = (at >= 0) & (e[np.maximum(at, 0)] <= own[1])
                own = tuple(x[~worse] for x in own)
        if len(own[0]):
            fronts[key] = own
    return fronts


def leaf_size(most: int) -> int:
    """Layers of the smallest segments."""
    n = 2
    while n < BLOCK and comb(n, most) <= TRIED:
        n += 1
    return n


@cache
def places(n: int, changes: int) -> np.ndarray:
    """All ways to cut n layers so many times."""
    return np.array(list(combinations(range(1, n), changes)), np.int64).reshape(comb(n - 1, changes), changes)


def leaf(rows: pd.DataFrame, net, most: int) -> Segment:
    """A few layers as a segment: all places of the changes at once, from sums over the first layers."""
    n, idx, mb = len(rows), rows.idx.to_numpy(), rows.mb.to_numpy()
    least, relaxed_ = float(rows.least.sum()), float(rows.relaxed.sum())
    rest = net.all_least - least, net.all_relaxed - relaxed_
    on_dla = (rows["compat"].astype(bool) & rows.dla_ms.notna() & rows.dla_mj.notna()).to_numpy()
    first_layers = lambda x: np.append(0.0, np.cumsum(x))
    none = np.zeros(n)
    sums = {"G": [first_layers(x) for x in (rows.gpu_ms, rows.gpu_mj, none)], "D": [first_layers(x) for x in (np.where(on_dla, rows.dla_ms, 0), np.where(on_dla, rows.dla_mj, 0), ~on_dla)]}
    found: dict[tuple, list] = {}
    for k in range(min(most, n - 1) + 1):
        at = places(n, k)
        edges = np.hstack([np.zeros((len(at), 1), np.int64), at, np.full((len(at), 1), n)])
        moved = mb[at - 1].sum(1)
        for proc in "GD":
            t, e, bad = k * CHANGE_MS + moved * CHANGE_MS_MB, k * CHANGE_MJ + moved * CHANGE_MJ_MB, np.zeros(len(at))
            own = proc
            for j in range(k + 1):
                own = proc if j % 2 == 0 else "DG"[proc == "D"]
                t, e, bad = (x + s[edges[:, j + 1]] - s[edges[:, j]] for x, s in zip((t, e, bad), sums[own], strict=True))
            some = np.flatnonzero((bad == 0) & possible(t, e, *rest, net))
            if len(some):
                cuts = np.full((len(some), most), -1, np.int32)
                cuts[:, :k] = idx[at[some]]
                found[proc, own, k] = [front(t[some], e[some], cuts)]
    return Segment(int(idx[0]), int(idx[-1]), float(mb[-1]), least, relaxed_, best_of(found))


def rows_of(s: Segment | None, net, seg: int) -> pd.DataFrame:
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    rows = []
    for (p, q, k), (t, e, cuts) in (s.fronts if s else {}).items():
        rows += [(net.net, seg, s.start, s.end, p, q, k, a, b, c[:k], s.mb, s.least, s.relaxed, net.budget, net.bound, net.multiplier, net.all_least, net.all_relaxed) for a, b, c in zip(t.tolist(), e.tolist(), cuts.tolist(), strict=True)]
    return pd.DataFrame(rows, columns=names)


def solved_in_rounds(layers: DataFrame, energy_share: float = 0.8, max_transitions: int = 3, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Per network the fastest schedule with at most max_transitions changes of processor whose energy is at most energy_share
    of all-GPU; all-GPU if there is none. layers: net, idx (0, 1, ...), gpu_ms, gpu_mj, dla_ms, dla_mj, size, compat. Gives
    net, first_proc, cuts (places of the layers before which the processor changes), time_ms, energy_mj, transitions."""
    most, size = max_transitions, leaf_size(max_transitions)
    bound = solved_one_change(layers, energy_share) if most else layers.groupBy("net").agg(F.lit(None).cast("double").alias("time_ms"), F.lit(None).cast("double").alias("energy_mj"))
    own = relaxed(layers.select("net", F.col("idx").cast("long").alias("idx"), "gpu_ms", "gpu_mj", "dla_ms", "dla_mj", (F.col("size") / MIB).alias("mb"), F.coalesce("compat", F.lit(False)).alias("compat")), energy_share)
    # all-GPU stands there where no schedule fits the budget: then time bounds nothing
    own = own.join(bound.select("net", "time_ms", "energy_mj"), "net").withColumn("bound", F.when(F.col("energy_mj") <= F.col("budget") + SLACK, F.col("time_ms")).otherwise(F.lit(float("inf"))))
    own = own.drop("time_ms", "energy_mj")

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        net, done, own = pdf.iloc[0], None, pdf.sort_values("idx")
        for i in range(0, len(own), size):
            one = leaf(own.iloc[i : i + size], net, most)
            done = joined(done, one, net, most) if done else one
        return rows_of(done, net, int(net.idx) // block)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        net, done, seg = pdf.iloc[0], None, int(pdf.seg.iloc[0]) // fan
        for _, own in sorted(pdf.groupby("start"), key=lambda g: g[0]):
            fronts = {}
            for key, f in own.groupby(["first", "last", "changes"]):
                cuts = np.full((len(f), most), -1, np.int32)
                for i, c in enumerate(f.cuts):
                    cuts[i, : len(c)] = c
                order = np.argsort(f.ms.to_numpy(), kind="stable")
                fronts[key] = f.ms.to_numpy()[order], f.mj.to_numpy()[order], cuts[order]
            h = own.iloc[0]
            one = Segment(int(h.start), int(h.end), h.mb, h.least, h.relaxed, fronts)
            if done and one.start != done.end + 1:  # nothing was possible in between
                return rows_of(None, net, seg)
            done = joined(done, one, net, most) if done else one
        return rows_of(done, net, seg)

    number: Column = F.floor(F.col("idx") / block)
    segments = own.groupBy("net", number.alias("_b")).applyInPandas(start, SEGMENT)
    blocks = (layers.agg(F.max("idx")).first()[0] or 0) // block + 1
    while blocks > 1:
        segments = segments.groupBy("net", F.floor(F.col("seg") / fan).alias("_s")).applyInPandas(join, SEGMENT)
        blocks = -(-blocks // fan)
    whole = own.groupBy("net").agg(F.max("idx").alias("end"), F.sum("gpu_ms").alias("gpu_ms"), F.sum("gpu_mj").alias("gpu_mj"))
    best = segments.where("start = 0 AND mj <= budget + 1e-9").groupBy("net", "end").agg(F.min(F.struct(F.round("ms", 9).alias("ms"), F.round("mj", 9).alias("mj"), "changes", "first", "cuts")).alias("b"))
    out = whole.join(best, ["net", "end"], "left")
    none = F.array().cast("array<int>")
    return out.select("net", F.coalesce("b.first", F.lit("G")).alias("first_proc"), F.coalesce("b.cuts", none).alias("cuts"), F.coalesce("b.ms", "gpu_ms").alias("time_ms"), F.coalesce("b.mj", "gpu_mj").alias("energy_mj"), F.coalesce("b.changes", F.lit(0)).alias("transitions"))
