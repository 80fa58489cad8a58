"""Operator 11: hard negatives from inverted lists of k-means clusters.

Every component c counts as the integer floor(256*c), so scores (inner products) are exact. Centroids are fitted on a sample
of at most SAMPLE rows and SAMPLE_BYTES bytes, chosen by a hash; every row then goes to its nearest centroid, and each
cluster keeps the greatest distance of its rows, its radius. By Cauchy-Schwarz no row x of a cluster has a score with an
anchor a outside <a, centroid> +- |a| * radius.

A search has one or more windows of scores for each anchor and finds the k best rows in each. It visits first the cluster
with the greatest upper bound, whose k-th score becomes the floor of the window. Then it visits the others, the greatest
bound first: a cluster whose bounds lie outside all windows is skipped, and the visit stops when the upper bound falls
strictly below the k-th score. The first search has one window without ends, over rows of the anchor's label; the second
has one for each positive found, over rows of other labels.

Lists are cut into shelves of equal numbers of rows, whatever their clusters' sizes; a task holds one shelf and streams the
anchors past it, so neither a hot cluster nor many anchors fill its memory. What is broadcast is MOST_CLUSTERS centroids.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as if they
ended in zeros. Rows with the anchor's id are never its positives; equal rows are candidates each, but one anchor. Scores
saturate at the ends of the 64-bit range. No anchors or an empty table give no rows. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import parts, written
from .whitening import finite, scaled_integers

SAMPLE, SAMPLE_BYTES, MOST_CLUSTERS, ROUNDS = 16_384, 32 << 20, 1024, 8
#: Rows for which there is one more cluster, and bytes of a shelf as a task holds it.
EACH, SHELF_BYTES = 1000, 24 << 20
#: Scores that a task holds at once.
SCORES = 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Relative allowance for the rounding of bounds.
SLACK = 1e-9
ROW = "shelf int, query boolean, cluster int, id long, label long, mark long, x binary, lows array<long>, highs array<long>, floors array<long>"


def rows_of(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equally long vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def lists_of(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([(half - x[i : i + 2048] @ centroids.T).argmin(1) for i in range(0, len(x), 2048)])


def k_means(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds from k different rows; a centroid that loses all rows stays where it is."""
    different = np.unique(x, axis=0)
    out = different[np.random.default_rng(seed).permutation(len(different))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, out)
        order = np.argsort(own, kind="stable")
        full, first, number = np.unique(own[order], return_index=True, return_counts=True)
        out[full] = np.add.reduceat(x[order], first, axis=0) / number[:, None]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, saturated."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


@dataclass
class Clusters:
    """Centroids, radii and numbers of rows, and where the rows of each stand on the shelves."""

    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    shelf: int
    kind: str

    def __post_init__(self):
        self.before = np.cumsum(self.rows) - self.rows
        self.parts = np.maximum(1, -(-self.rows // self.shelf))
        self.shelves = int(-(-self.rows.sum() // self.shelf))
        self.on = [np.unique(self.place(np.full(p, k), np.arange(p))) for k, p in enumerate(self.parts)]

    def place(self, cluster: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The shelf of a part of a cluster."""
        at = self.before[cluster] + (part + 0.5) * self.rows[cluster] / self.parts[cluster]
        return np.minimum((at / self.shelf).astype(np.int64), self.shelves - 1)

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest score) that a row of each cluster can have with each anchor."""
        a = a.astype(np.float64)
        norm = np.sqrt((a**2).sum(1))[:, None]
        middle, reach = a @ self.centroids.T, norm * self.radius
        reach = reach * (1 + SLACK) + SLACK * (norm * np.sqrt((self.centroids**2).sum(1)) + 1)
        return middle - reach, middle + reach

    def eligible(self, a: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """By anchor and cluster: may a row be inside any of the anchor's windows?"""
        least, greatest = self.bounds(a)
        out = np.zeros(least.shape, bool)
        for lo, hi in zip(lows.T, highs.T, strict=True):
            out |= (lo <= hi)[:, None] & (greatest >= lo[:, None]) & (least <= hi[:, None])
        return out & (self.rows > 0)

    def first(self, a: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """The cluster with the greatest upper bound; -1 if none is eligible."""
        may = self.eligible(a, lows, highs)
        best = np.where(may, self.bounds(a)[1], -np.inf).argmax(1)
        return np.where(may.any(1), best, -1)


class Shelf:
    """The list rows of one task, and the visits of anchors to their clusters."""

    def __init__(self, clusters: Clusters, cluster: np.ndarray, ids: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, cluster))
        cluster, self.ids, self.label, self.x = cluster[order], ids[order], label[order], x[order]
        self.clusters = clusters
        self.own, start = np.unique(cluster, return_index=True)
        self.range = list(zip(start.tolist(), np.append(start[1:], len(cluster)).tolist(), strict=True))

    def visits(self, q: dict[str, np.ndarray], k: int, same: bool, first: bool):
        """(anchor's row, window, score, id) of rows that may be among the k best of their window."""
        a, lows, highs = q["x"], q["lows"], q["highs"]
        floors = np.maximum(lows, q["floors"])
        top = np.full((*lows.shape, k), LEAST)
        may = self.clusters.eligible(a, floors, highs)[:, self.own]
        is_first = self.own[None, :] == q["cluster"][:, None]
        may &= is_first if first else ~is_first
        bound = self.clusters.bounds(a)[1][:, self.own]
        found = []
        for c in np.argsort(-np.where(may, bound, -np.inf).max(0)):
            i, j = self.range[c]
            # the visit stops for an anchor whose bound is strictly below the k-th scores of all its windows
            open_ = np.flatnonzero(may[:, c] & ((floors <= highs) & (floors <= bound[:, c : c + 1])).any(1))
            step = max(1, SCORES // (j - i))
            for b in range(0, len(open_), step):
                own = open_[b : b + step]
                score = products(a[own], self.x[i:j])
                right = self.label[i:j] == q["label"][own][:, None]
                right = right & (self.ids[i:j] != q["id"][own][:, None]) if same else ~right
                for w in range(lows.shape[1]):
                    inside = right & (score >= floors[own, w][:, None]) & (score <= highs[own, w][:, None])
                    some = np.flatnonzero(inside.any(1))
                    if not len(some):
                        continue
                    inside, s = inside[some], np.where(inside[some], score[some], LEAST)
                    best = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, -k:]
                    limit = best.min(1)[:, None] if s.shape[1] >= k else np.full((len(some), 1), LEAST)
                    more = s > limit
                    ties = inside & (s == limit)  # of these the least ids, as rows stand by id
                    take = inside & more | ties & (np.cumsum(ties, axis=1) <= k - more.sum(1)[:, None])
                    row, col = np.nonzero(take)
                    found.append((own[some[row]], np.full(len(row), w), s[row, col], self.ids[i:j][col]))
                    held = np.concatenate([top[own[some], w], best], axis=1)
                    top[own[some], w] = np.partition(held, held.shape[1] - k, axis=1)[:, -k:]
                    floors[own[some], w] = np.maximum(floors[own[some], w], top[own[some], w].min(1))
        row, w, score, ids = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        keep = np.flatnonzero(score >= floors[row, w])
        keep = keep[np.lexsort((ids[keep], ~score[keep], w[keep], row[keep]))]
        group = row[keep] * lows.shape[1] + w[keep]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        keep = keep[np.arange(len(keep)) - np.repeat(start, np.diff(np.append(start, len(keep)))) < k]
        return row[keep], w[keep], score[keep], ids[keep]


def clustered(own: DataFrame, size: int, n: int, largest: int, clusters: int | None, shelf: int | None) -> tuple[DataFrame, Clusters]:
    """(lists: id, label, mark, x, cluster, salt, written; their clusters)."""
    spark = own.sparkSession
    limit = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    # a hash's range holds about twice as many rows as are wanted, so no task sorts many more
    share = own if n <= 2 * limit else own.where(F.abs(F.xxhash64("id", "mark") % 1_000_003) < 1_000_003 * 2 * limit // n + 1)
    some = share.orderBy(F.xxhash64("mark", "id"), "id").limit(limit).select("x").toArrow().column("x").combine_chunks()
    fitted = k_means(lists_of(some).astype(np.float64), clusters or max(1, min(MOST_CLUSTERS, n // EACH)))
    sent = spark.sparkContext.broadcast(fitted)
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"

    def assign(batches):
        for b in batches:
            x = lists_of(b.column(3))
            at = nearest(x.astype(np.float64), sent.value)
            apart = np.sqrt(((x - sent.value[at]) ** 2).sum(1))
            packed = x.astype(kind)
            offsets = np.arange(len(x) + 1, dtype=np.int64) * packed.shape[1] * packed.itemsize
            salt = np.random.default_rng(b.num_rows).integers(0, 1 << 31, b.num_rows)
            body = pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], body, pa.array(at, pa.int32()), pa.array(salt, pa.int32()), pa.array(apart)], names=["id", "label", "mark", "x", "cluster", "salt", "apart"])

    lists = written(own.select("id", "label", "mark", "x").mapInArrow(assign, "id long, label long, mark long, x binary, cluster int, salt int, apart double"), "lists")
    radius, rows = np.zeros(len(fitted)), np.zeros(len(fitted), np.int64)
    for r in lists.groupBy("cluster").agg(F.max("apart").alias("radius"), F.count("*").alias("rows")).collect():  # a row a cluster
        radius[r.cluster], rows[r.cluster] = r.radius, r.rows
    held = shelf or max(1, min(SHELF_BYTES // (8 * size), -(-n // parts(spark))))
    return lists.drop("apart"), Clusters(fitted, radius, rows, held, kind)


def aimed(queries: DataFrame, clusters) -> DataFrame:
    """Queries (id, label, mark, x, lows, highs) with the cluster that each visits first."""

    def run(batches):
        for b in batches:
            own = clusters.value
            best = own.first(rows_of(b.column(3), own.kind), lists_of(b.column(4)), lists_of(b.column(5)))
            yield b.append_column("cluster", pa.array(best, pa.int32()))

    return queries.select("id", "label", "mark", "x", "lows", "highs").mapInArrow(run, "id long, label long, mark long, x binary, lows array<long>, highs array<long>, cluster int")


def sent_out(queries: DataFrame, clusters, first: bool) -> DataFrame:
    """Queries with `floors`, once for each shelf on which they have a cluster to visit."""

    def run(batches):
        own = clusters.value
        for b in batches:
            a = rows_of(b.column(3), own.kind)
            best, lows, highs, floors = np.asarray(b.column(6)), *(lists_of(b.column(i)) for i in (4, 5, 7))
            if first:
                shelves = [own.on[c] if c >= 0 else np.zeros(0, np.int64) for c in best]
            else:
                may = own.eligible(a, np.maximum(lows, floors), highs)
                may[np.arange(len(a)), best] = False
                shelves = [np.unique(np.concatenate([np.zeros(0, np.int64), *[own.on[c] for c in np.flatnonzero(m)]])) for m in may]
            times = np.array([len(s) for s in shelves])
            every = np.concatenate([np.zeros(0, np.int64), *shelves]).astype(np.int32)
            row = np.repeat(np.arange(len(a)), times)
            for i in range(0, len(row), 1000):
                t = b.take(pa.array(row[i : i + 1000]))
                n = t.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(every[i : i + 1000]), pa.array(np.ones(n, bool)), t.column(6), t.column(0), t.column(1), t.column(2), t.column(3), t.column(4), t.column(5), t.column(7)], names=[x.split()[0] for x in ROW.split(", ")])

    return queries.select("id", "label", "mark", "x", "lows", "highs", "cluster", "floors").mapInArrow(run, ROW)


def visited(lists: DataFrame, queries: DataFrame, clusters, k: int, same: bool, first: bool) -> DataFrame:
    """(a_id, a_mark, w, score, id): what the queries find on the shelves that they are sent to."""
    n = clusters.value.shelves

    def on_shelf(batches):
        for b in batches:
            own = clusters.value
            cluster, salt = np.asarray(b.column(4)), np.asarray(b.column(5))
            at = own.place(cluster, salt % own.parts[cluster]).astype(np.int32)
            none = [pa.nulls(b.num_rows, pa.list_(pa.int64()))] * 3
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(b.num_rows, bool)), b.column(4), b.column(0), b.column(1), b.column(2), b.column(3), *none], names=[x.split()[0] for x in ROW.split(", ")])

    def visit(batches):
        own, held, shelf = clusters.value, [], None
        for b in batches:
            query = np.asarray(b.column(1))
            if not query.all():
                l = b.filter(pa.array(~query))
                held.append((np.asarray(l.column(2)), np.asarray(l.column(3)), np.asarray(l.column(4)), rows_of(l.column(6), own.kind)))
            if query.any() and held:
                shelf = shelf or Shelf(own, *map(np.concatenate, zip(*held, strict=True)))
                b = b.filter(pa.array(query))
                q = {name: np.asarray(b.column(i)) for name, i in (("cluster", 2), ("id", 3), ("label", 4))} | {"x": rows_of(b.column(6), own.kind)}
                q |= {name: lists_of(b.column(i)) for name, i in (("lows", 7), ("highs", 8), ("floors", 9))}
                row, w, score, ids = shelf.visits(q, k, same, first)
                yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(row)), b.column(5).take(pa.array(row)), pa.array(w, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())], names=["a_id", "a_mark", "w", "score", "id"])

    rows = lists.select("id", "label", "mark", "x", "cluster", "salt").mapInArrow(on_shelf, ROW).unionByName(sent_out(queries, clusters, first))
    # a partition for each shelf; its lists come before the queries
    return rows.repartitionById(n, F.col("shelf")).sortWithinPartitions("query").mapInArrow(visit, "a_id long, a_mark long, w int, score long, id long")


def search(lists: DataFrame, queries: DataFrame, clusters, k: int, same: bool) -> DataFrame:
    """(a_id, a_mark, w, score, id, rank): the k best rows in each window of each query."""
    own = written(aimed(queries, clusters), "queries")
    unknown = own.withColumn("floors", F.transform("lows", lambda _: F.lit(LEAST)))
    hits = written(visited(lists, unknown, clusters, k, same, True), "hits")
    # a query has k hits a window from each shelf of one cluster
    kth = hits.groupBy("a_id", "a_mark", "w").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("floor")).where("floor IS NOT NULL")
    kth = kth.groupBy(F.col("a_id").alias("id"), F.col("a_mark").alias("mark")).agg(F.map_from_entries(F.collect_list(F.struct("w", "floor"))).alias("kth"))
    floors = F.transform("lows", lambda lo, w: F.coalesce(F.try_element_at(F.col("kth"), w), F.lit(LEAST)))
    rest = visited(lists, own.join(kth, ["id", "mark"], "left").withColumn("floors", floors), clusters, k, same, False)
    order = Window.partitionBy("a_id", "a_mark", "w").orderBy(F.desc("score"), "id")
    return hits.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, every: int = 100, clusters: int | None = None, shelf: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Anchors are rows whose id is divisible by `every`. For each anchor and each of its first `positives` rows of the same
    label: the first k rows of other labels with low % to high % of the positive's score. Columns: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score. Higher scores come first, then smaller ids."""
    own = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    magnitude = F.array_max(F.transform("vector", lambda c: F.abs(c.cast("double"))))
    facts = own.agg(F.max(F.size("vector")).alias("size"), F.count("*").alias("n"), F.max(magnitude).alias("largest")).first()
    size = max(1, facts.size or 1)
    own = own.select("id", "label", scaled_integers(F.col("vector"), size).alias("x")).withColumn("mark", F.xxhash64("label", "x"))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts.n:
        return embeddings.sparkSession.createDataFrame([], result)
    lists, found = clustered(own, size, facts.n, min(int((facts.largest or 0) * 256 + 2), MOST), clusters, shelf)
    sent = embeddings.sparkSession.sparkContext.broadcast(found)
    anchors = lists.where(F.col("id") % every == 0).dropDuplicates(["id", "mark"]).drop("cluster", "salt")
    open_ = anchors.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))})
    best = search(lists, open_, sent, positives, True)
    best = best.groupBy(F.col("a_id").alias("id"), F.col("a_mark").alias("mark")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("p_id"), "score"))).alias("best"))
    best = written(best, "positives")

    def percent(s, p: int, up: int):
        """p % of a long, rounded down, or up with 99."""
        rest = F.pmod(s, F.lit(100))
        return F.call_function("div", s - rest, F.lit(100)) * p + F.call_function("div", rest * p + up, F.lit(100))

    def ends(p: int, up: int, none: int):
        """One end of each positive's window; a window that holds nothing for a positive that isn't there."""
        given = F.transform("best", lambda b: percent(b["score"], p, up))
        return F.concat(given, F.array_repeat(F.lit(none), F.lit(positives) - F.size("best")))

    windows = anchors.join(best, ["id", "mark"]).withColumns({"lows": ends(low, 99, MOST), "highs": ends(high, 0, LEAST)})
    negatives = search(lists, windows, sent, k, False).withColumnRenamed("id", "negative_id")
    out = negatives.join(best.select(F.col("id").alias("a_id"), F.col("mark").alias("a_mark"), "best"), ["a_id", "a_mark"]).withColumn("p", F.get("best", F.col("w")))
    return out.select(F.col("a_id").alias("anchor_id"), F.col("p.p_id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


#: The rows of the query in SQL, where ids are unique and vectors equally long.
SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NOT NULL AND isfinite(c)]) = len(embedding)
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM own AS a, own AS b WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives AS p JOIN scores AS n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
) WHERE rank <= 10
"""
