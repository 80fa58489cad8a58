"""Operator 12: whitening of embeddings by column aggregates.

Every component c becomes the integer x = floor(256*c). The covariance of the different x-vectors comes from SQL
expressions generated for the upper triangle: one sum of centred products for each pair of dimensions, all in one
aggregation (beyond PAIRS of them, which 90 dimensions make, in several). Only these sums reach the driver, where LAPACK
decomposes the matrix. Rows are then projected by generated expressions too: no row leaves the JVM.

Rows whose vector is null or holds a null or non-finite entry are dropped; rows without an id stay. Vectors of different
lengths count as if the shorter ones ended in zeros. Equal rows each have their own result, and a vector that stands on
many rows is fitted once. `floor` saturates at the ends of the 64-bit range, and `deviation` is null where it doesn't fit
64 bits. A component without variance (fewer different vectors than dimensions, say) has whitened 0, and identity_error is
then 1. No rows, or only empty vectors, give no rows. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

#: Sums in one aggregation, and components that are returned.
PAIRS, COMPONENTS = 4096, 4
#: A component with a smaller share of the variance has none but by rounding.
LEAST_SHARE = 1e-13


def finite(vector: Column) -> Column:
    """Is the vector there, with all its entries finite? Never null."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def scaled_integers(vector: Column, size: int) -> Column:
    """The first `size` entries as long floor(256*c), with zeros where the vector is shorter."""
    x = F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")))
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(x)))


def total(expressions: dict[str, Column], df: DataFrame) -> dict:
    """One aggregate for each name, PAIRS at a time."""
    names, out = list(expressions), {}
    for i in range(0, len(names), PAIRS):
        out |= df.agg(*[expressions[k].alias(k) for k in names[i : i + PAIRS]]).first().asDict()
    return out


def covariance(centred: DataFrame, size: int, n: int) -> np.ndarray:
    """Of the columns c0, c1, ...: sums of products over the upper triangle, mirrored, divided by n."""
    sums = total({f"p{i}_{j}": F.expr(f"sum(c{i} * c{j})") for i in range(size) for j in range(i, size)}, centred)
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = sums[f"p{i}_{j}"] / n
    return out


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as rows, the largest entry of each positive)."""
    value, vector = np.linalg.eigh(v)
    value, vector = np.maximum(value[::-1], 0.0), vector.T[::-1]
    top = vector[np.arange(len(vector)), np.abs(vector).argmax(1)]
    return value, vector * np.where(top < 0, -1.0, 1.0)[:, None]


def whitened(embeddings: DataFrame, n_components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row and component (from 1, by falling variance): id_col, component, n (different vectors), deviation (exact sum of
    squares of n*x - S, where S are the sums over the different vectors), whitened, explained (share of the variance) and
    identity_error (largest entry of the whitened vectors' covariance less the identity)."""
    own = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(finite(F.col("vector")))
    size = own.agg(F.max(F.size("vector"))).first()[0] or 0
    longs, reals = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField(id_col, embeddings.schema[id_col].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", longs), T.StructField("deviation", longs), *[T.StructField(x, reals) for x in ("whitened", "explained", "identity_error")]])
    if not size:
        return embeddings.sparkSession.createDataFrame([], schema)
    own = own.select("id", scaled_integers(F.col("vector"), size).alias("x"))
    fit = written(own.select("x").distinct(), "fit")  # read four times
    sums = total({"n": F.count("*")} | {f"s{i}": F.sum(F.col("x")[i].cast("decimal(20,0)")) for i in range(size)}, fit)
    n, s = sums["n"], [int(sums[f"s{i}"]) for i in range(size)]
    mean = [x // n + (x % n) / n for x in s]
    # never null, so that the sums need no test for it
    entry = lambda i: F.coalesce(F.get("x", F.lit(i)), F.lit(0).cast("long")).cast("double")
    centred = fit.select(*[(entry(i) - F.lit(mean[i])).alias(f"c{i}") for i in range(size)])
    value, vector = components(covariance(centred, size, n))
    trace, k = float(value.sum()), min(n_components, size)

    def projected(x: Column, j: int) -> Column:
        if value[j] <= LEAST_SHARE * trace:
            return F.lit(0.0)
        weights = F.array(*[F.lit(float(w / np.sqrt(value[j]))) for w in vector[j]])
        centre = F.transform(x, lambda v, i: v - F.get(means, i))
        return F.aggregate(F.zip_with(centre, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    means = F.array(*[F.lit(float(m)) for m in mean])
    of_fit = fit.select(*[projected(F.col("x"), j).alias(f"c{j}") for j in range(k)])
    average = of_fit.agg(*[F.avg(f"c{j}").alias(f"c{j}") for j in range(k)]).first()
    spread = covariance(of_fit.select(*[(F.col(f"c{j}") - F.lit(average[j])).alias(f"c{j}") for j in range(k)]), k, n)
    error = float(np.abs(spread - np.eye(k)).max())
    if all(-(1 << 63) <= x < 1 << 63 for x in s):
        apart = F.zip_with("x", F.array(*[F.lit(x).cast("long") for x in s]), lambda a, b: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), a), b))
        deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    else:
        deviation = F.lit(None).cast("long")
    rows = [F.struct(F.lit(j + 1).alias("component"), projected(F.col("x"), j).alias("whitened"), F.lit(float(value[j] / trace) if trace else 0.0).alias("explained")) for j in range(k)]
    out = own.select("id", deviation.alias("deviation"), F.explode(F.array(*rows)).alias("r"))
    return out.select(F.col("id").alias(id_col), "r.component", F.lit(n).cast("long").alias("n"), "deviation", "r.whitened", "r.explained", F.lit(error).alias("identity_error"))
