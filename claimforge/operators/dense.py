"""Exact cosine search by blocks: one matrix product a tile, the best of each tile, then the best over tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a tile, and queries of one product within it (bounds memory).
BLOCK_ROWS, QUERY_ROWS, PRODUCT_ROWS = 8192, 1024, 128
DIGITS = 6
FOUND = "query_id long, vec_id long, score double"


def normalised(v: Column) -> Column:
    """An array scaled to unit length; a zero vector stays as it is."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    m = np.stack(vectors)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def best_of_tile(queries: list[tuple], rows: list[tuple], k: int):
    """Record batches (query_id, vec_id, score) of the k best rows of the tile for each query, ties to smaller ids."""
    rows = sorted(rows, key=lambda r: r[0])
    ids, m = np.array([r[0] for r in rows], np.int64), matrix([r[1] for r in rows])
    for at in range(0, len(queries), PRODUCT_ROWS):
        some = queries[at : at + PRODUCT_ROWS]
        own = np.array([q[0] for q in some], np.int64)
        score = np.round(matrix([q[1] for q in some]) @ m.T, DIGITS) + 0.0
        score[own[:, None] == ids[None, :]] = -np.inf
        floor = np.partition(score, len(ids) - k, axis=1)[:, -k] if len(ids) > k else np.full(len(own), -np.inf)
        q, c = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        order = np.lexsort((c, -score[q, c], q))
        q, c = q[order], c[order]
        few = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, c = q[few], c[few]
        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[c]), pa.array(score[q, c])], names=["query_id", "vec_id", "score"])


def dense_search(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, vec_id, score, rank of the k nearest other rows by cosine (6 decimals), ties to smaller ids.

    Both tables are dealt into blocks of about block_rows and query_rows, counted first; each block of one meets each of the other in a task that
    streams over its tiles. Per query and tile k rows are handed on. Rows without an id or a vector, or with null components, take no part; vectors of
    another length don't meet; a zero vector has the cosine 0 with all.
    """
    partitions = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = []
    for df in (queries, corpus):
        v = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        sides.append(v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).withColumn("dim", F.size("v")))
    n_queries, n_rows = (max(1, -(-df.count() // size)) for df, size in zip((queries, corpus), (query_rows, block_rows), strict=True))
    block = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    both = sides[0].withColumns({"q": block(n_queries), "side": F.lit(0)}).withColumn("c", every(n_rows)).unionByName(sides[1].withColumns({"c": block(n_rows), "side": F.lit(1)}).withColumn("q", every(n_queries)))
    tiles = both.repartition(max(partitions, min(n_queries * n_rows, 8 * partitions)), "dim", "q", "c").sortWithinPartitions("dim", "q", "c", "side")

    def multiply(batches):
        at, held = None, ([], [])
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in ("dim", "q", "c", "side", "id")}
            v = batch.column("v")
            flat, bounds = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(columns["dim"])])
            for i in range(batch.num_rows):
                now = (columns["dim"][i], columns["q"][i], columns["c"][i])
                if now != at:
                    if held[0] and held[1]:
                        yield from best_of_tile(*held, k)
                    at, held = now, ([], [])
                held[columns["side"][i]].append((columns["id"][i], flat[bounds[i] : bounds[i + 1]]))
        if held[0] and held[1]:
            yield from best_of_tile(*held, k)

    def merge(batches):
        """A query's rows come best first: the first k are its answer."""
        query, seen = None, 0
        for batch in batches:
            rank = []
            for q in batch.column("query_id").to_pylist():
                query, seen = (q, seen + 1) if q == query else (q, 1)
                rank.append(seen)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int32())], names=["query_id", "vec_id", "score", "rank"])
            yield out.filter(pa.array([r <= k for r in rank], pa.bool_()))

    found = tiles.mapInArrow(multiply, FOUND)
    return found.repartition(partitions, "query_id").sortWithinPartitions("query_id", F.desc("score"), "vec_id").mapInArrow(merge, f"{FOUND}, rank int")
