"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are scaled to unit length and quantised to int8, each with its scale and the exact length of its quantisation
error. Queries and candidates are dealt into blocks; the product of two blocks gives approximate cosines and, by the errors'
lengths, bounds around them. Only codes travel to the tiles. In each tile, and then over all tiles, only pairs whose upper bound reaches
the k-th best lower bound of their query survive; they meet the original vectors and are recomputed in double precision. A heap per
query merges them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, read, written

#: Candidates and queries of a tile, and of one product within it (bounds memory).
BLOCK, QUERY_BLOCK, PRODUCT_ROWS = 8192, 1024, 64
NEIGHBOURS = 5


def quantised(v: np.ndarray) -> tuple[np.ndarray, float, float]:
    """int8 codes, scale and error length of a vector of unit length (the error holds rounding of this arithmetic too)."""
    scale = float(np.abs(v).max()) / 127
    q = np.rint(v / scale)
    return q.astype(np.int8), scale, float(np.linalg.norm(v - q * scale)) + 1e-12


def prepared(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, dim, vector, codes, scale, error) of usable vectors; unusable ones (null, empty, zero, with null or non-finite components) are left out.

    Vectors are first brought to a largest component between 1/2 and 1 by a power of two, which changes no cosine and no digit, so
    that squares neither overflow nor vanish.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if i is None or not x or None in x:
                    continue
                v = np.array(x, np.float64)
                if not np.isfinite(v).all() or not v.any():
                    continue
                v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
                q, scale, error = quantised(v / np.linalg.norm(v))
                rows.append((i, len(v), v.tobytes(), q.tobytes(), scale, error))
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["vec_id", "dim", "vector", "codes", "scale", "error"])

    chosen = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, "vec_id long, dim int, vector binary, codes binary, scale double, error double")


class Tile:
    """Rows of one side of a tile as arrays."""

    def __init__(self, rows: list[tuple], dim: int):
        self.ids = np.array([r[0] for r in rows], np.int64)
        # int8 products summed in float32 are exact below 2**24: 127 * 127 * dim for dim up to 1040; above, float64
        self.codes = np.frombuffer(b"".join(r[1] for r in rows), np.int8).reshape(-1, dim).astype(np.float32 if dim <= 1040 else np.float64)
        self.scale, self.error = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])


def best_of_tile(queries: Tile, candidates: Tile, k: int) -> list[np.ndarray]:
    """[query ids, candidate ids, lower bounds, upper bounds] of the pairs that may be among the k best of their query in this tile."""
    out = []
    for at in range(0, len(queries.ids), PRODUCT_ROWS):
        some = slice(at, at + PRODUCT_ROWS)
        cosine = (queries.codes[some] @ candidates.codes.T) * queries.scale[some, None] * candidates.scale[None, :]
        eq, ec = queries.error[some, None], candidates.error[None, :]
        slack = eq + ec + 3 * eq * ec + 1e-9
        cosine[queries.ids[some, None] == candidates.ids[None, :]] = -np.inf
        low, high = cosine - slack, cosine + slack
        kth = np.partition(low, len(candidates.ids) - k, axis=1)[:, -k] if len(candidates.ids) > k else np.full(len(low), -np.inf)
        q, c = np.nonzero((high >= kth[:, None]) & (cosine > -np.inf))
        out.append((queries.ids[some][q], candidates.ids[c], low[q, c], high[q, c]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors by cosine for every row where is_query(id) holds.

    Exact: bounds prune, doubles decide. Unusable vectors take no part as queries or candidates; a query is never its own
    neighbour; vectors of another length are no candidates; of rows that repeat a vec_id one counts, the first in order of the vectors'
    bytes; ties go to smaller ids; a query with fewer than k candidates returns what there is. An empty table gives no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    n = n_partitions(spark)
    columns = ("vector", "dim", "codes", "scale", "error")
    once = prepared(vectors, id_column, vector_column).groupBy("vec_id").agg(F.min(F.struct(*columns)).alias("v"))
    ready = written(once.select("vec_id", *(F.col(f"v.{c}").alias(c) for c in columns)), "vectors")
    queries = ready.where(is_query(F.col("vec_id")))
    n_candidates, n_queries = ready.count(), queries.count()
    blocks, query_blocks = max(1, -(-n_candidates // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    block = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    coded = ready.select("vec_id", "dim", "codes", "scale", "error")
    sides = (
        coded.where(is_query(F.col("vec_id"))).withColumn("q", block(query_blocks, 1)).withColumn("c", every(blocks)).withColumn("side", F.lit(0))
        .unionByName(coded.withColumn("c", block(blocks, 2)).withColumn("q", every(query_blocks)).withColumn("side", F.lit(1)))
    )
    tiles = sides.repartition(max(n, min(blocks * query_blocks, 8 * n)), "dim", "q", "c").sortWithinPartitions("dim", "q", "c", "side")

    def multiply(batches):
        def result(key, sides):
            if key is None or not (sides[0] and sides[1]):
                return None
            found = best_of_tile(Tile(sides[0], key[0]), Tile(sides[1], key[0]), k)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "low", "high"])

        key, held = None, ([], [])
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in ("dim", "q", "c", "side", "vec_id", "codes", "scale", "error")}
            for i in range(batch.num_rows):
                now = (c["dim"][i], c["q"][i], c["c"][i])
                if now != key:
                    if (out := result(key, held)) is not None:
                        yield out
                    key, held = now, ([], [])
                held[c["side"][i]].append((c["vec_id"][i], c["codes"][i], c["scale"][i], c["error"][i]))
        if (out := result(key, held)) is not None:
            yield out

    bounded = tiles.mapInArrow(multiply, "query_id long, vec_id long, low double, high double")

    def prune(batches):
        """Over all tiles: a query's pairs come with the best lower bounds first, so the k-th one says which others may still be better."""
        query, seen, kth = None, 0, -np.inf
        for batch in batches:
            keep = []
            for q, low, high in zip(*(batch.column(x).to_pylist() for x in ("query_id", "low", "high")), strict=True):
                if q != query:
                    query, seen, kth = q, 0, -np.inf
                seen += 1
                if seen == k:
                    kth = low
                keep.append(high >= kth)
            yield batch.select(["query_id", "vec_id"]).filter(pa.array(keep, pa.bool_()))

    alive = bounded.repartition(n, "query_id").sortWithinPartitions("query_id", F.desc("low")).mapInArrow(prune, "query_id long, vec_id long")
    originals = ready.select("vec_id", "vector")
    met = alive.join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).hint("merge"), "query_id").join(originals.hint("merge"), "vec_id").select("query_id", "vec_id", "query", "vector")

    def exact(batches):
        for batch in batches:
            score = []
            for a, b in zip(batch.column("query").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                x, y = np.frombuffer(a), np.frombuffer(b)
                score.append(float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(exact, "query_id long, vec_id long, score double")

    def merge(batches):
        def ranked(query, heap):
            best = sorted(heap, key=lambda x: (-x[0], -x[1]))
            return [(query, r + 1, -i, s) for r, (s, i) in enumerate(best)]

        query, heap = None, []
        for batch in batches:
            rows = []
            for q, v, s in zip(*(batch.column(x).to_pylist() for x in ("query_id", "vec_id", "score")), strict=True):
                if q != query:
                    rows += ranked(query, heap)
                    query, heap = q, []
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -v))
            yield out_batch(rows)
        yield out_batch(ranked(query, heap))

    def out_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

    return found.repartition(n, "query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose vec_id is divisible by 50."""
    return nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
