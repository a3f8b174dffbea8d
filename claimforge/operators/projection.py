"""Principal components of vectors: one pass for sums of products, components with fixed signs, all rows projected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vector: str, *kept: str) -> DataFrame:
    """kept and v, an array of doubles without nulls and non-finite numbers, which count as 0; rows without a vector are left out."""
    number = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return vectors.where(F.col(vector).isNotNull()).select(*kept, F.transform(F.col(vector).cast("array<double>"), number).alias("v"))


def products(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, i, j, s): for each length of vectors their number (i = j = -1), sums (j = -1) and sums of products (i <= j).

    Each task multiplies its batches as matrices and hands on one table of its own, so what is shuffled doesn't grow with the rows.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column("v")
            dims = np.array(v.value_lengths().to_pylist(), np.int64)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            for d in np.unique(dims).tolist():
                some = ends[dims == d]
                rows = np.concatenate([np.ones((len(some), 1)), np.array([flat[e - d : e] for e in some]).reshape(len(some), d)], axis=1)
                sums[d] = sums.get(d, 0) + rows.T @ rows
        for d, s in sums.items():
            i, j = np.triu_indices(d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(j - 1), pa.array(i - 1), pa.array(s[i, j])], names=["dim", "i", "j", "s"])

    parts = usable(vectors, vector).mapInArrow(run, "dim long, i long, j long, s double")
    one = parts.groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    return one.select("dim", F.when(F.col("j") < 0, F.col("i")).otherwise(F.least("i", "j")).alias("i"), F.when(F.col("j") < 0, F.col("j")).otherwise(F.greatest("i", "j")).alias("j"), "s")


def covariance(vectors: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(number of rows, mean, covariance) of the most frequent length; as large as the square of that length, whatever the rows."""
    found = products(vectors, vector)
    dims = found.where("i = -1").orderBy(F.desc("s"), "dim").select("dim", "s").first()
    if dims is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    d, n = dims.dim, dims.s
    t = found.where((F.col("dim") == d) & (F.col("i") >= 0)).toArrow()
    i, j, s = (t.column(c).to_numpy() for c in ("i", "j", "s"))
    mean, c = np.zeros(d), np.zeros((d, d))
    mean[i[j < 0]] = s[j < 0] / n
    pair = j >= 0
    c[i[pair], j[pair]] = c[j[pair], i[pair]] = s[pair]
    return int(n), mean, (c - n * np.outer(mean, mean)) / max(1, n - 1)


def components(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, components in rows): the k largest; each component's largest entry (the first of equals) is positive."""
    values, axes = np.linalg.eigh(c)
    order = np.argsort(-values, kind="stable")[:k]
    axes = axes[:, order].T
    largest = np.abs(np.round(axes, 9)).argmax(axis=1) if len(c) else np.zeros(0, np.int64)
    signs = np.where(axes[np.arange(len(axes)), largest] < 0, -1.0, 1.0) if len(c) else np.ones(len(axes))
    return np.maximum(values[order], 0), axes * signs[:, None]


def projected(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 2) -> DataFrame:
    """key, p (array of k doubles): every row's centred projection on the k principal components of all rows. Rows without a vector or of another
    length than most aren't returned; nor is any where there are less than two rows or fewer dimensions than components."""
    n, mean, c = covariance(vectors, vector)
    kind = dict(vectors.dtypes)[key]
    if n < 2 or len(mean) < k:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, p array<double>")
    _, axes = components(c, k)
    d = len(mean)

    def run(batches):
        for batch in batches:
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            p = (rows - mean) @ axes.T
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.reshape(-1)))], names=[key, "p"])

    return usable(vectors, vector, key).where(F.size("v") == d).mapInArrow(run, f"{key} {kind}, p array<double>")
