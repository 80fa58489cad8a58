"""Connected components of links that no single task could hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written
from .skew import counted, hot_keys, spread_join

#: Rows of which even one task may hold all.
FEW = 20_000


def looked_up(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """rows of a written table with the facts of their key, where there are any; a hub's rows are dealt out."""
    hot = hot_keys(counted(rows, key), key, "_rows") if rows.count() > FEW else None
    return spread_join(rows, facts, key, by, hot, "left")


def followed(hooks: DataFrame) -> DataFrame:
    """(node, label), written, with each label followed to where it leads, twice as far each time."""
    hooks, moves = written(hooks, "hooks"), True
    while moves:
        further = hooks.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = looked_up(hooks.select("node", "label"), further, "label", "node")
        new = written(jumped.select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")), "hooks")
        dropped(hooks)
        hooks, moves = new, new.where("moved").limit(1).count() > 0
    return hooks


def labelled(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, label): each node of links (u, v) with the least node of its component; and the written tables that this is
    read from.

    Links point from the greater node to the lesser. In each round every node with links hooks on to its least neighbour,
    the hooks are followed to their roots, and the links are drawn anew between the roots of their ends. Links inside a
    star vanish, so few are left after a round or two. Each round is a written table: a lost executor costs one round."""

    def directed(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges, rounds = written(directed(links.select("u", "v")), "links"), []
    while not rounds or edges.limit(1).count():
        own = followed(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")))
        rounds.append(own)
        a, b = (own.select(F.col("node").alias(x), F.col("label").alias(f"{x}_to")) for x in "uv")
        moved = looked_up(edges, a, "u", "v")
        moved = spread_join(moved, b, "v", "u", hot_keys(counted(edges, "v"), "v", "_rows") if edges.count() > FEW else None, "left")
        new = written(directed(moved.select(F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v"))), "links")
        dropped(edges)
        edges = new
    dropped(edges)
    hooks = rounds[0]
    if len(rounds) > 1:
        hooks = followed(reduce(DataFrame.unionByName, [own.select("node", "label") for own in rounds]))
        dropped(*rounds)
    own = hooks.select("node", "label")
    return own.unionByName(own.select(F.col("label").alias("node"), "label").distinct()), [hooks]


def connected_components(links: DataFrame) -> DataFrame:
    return labelled(links)[0]
