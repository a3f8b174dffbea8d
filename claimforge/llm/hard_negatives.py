"""Hard-negative mining by slots of scores.

Vectors become whole numbers, so scores are exact. Anchors and rows are dealt into blocks; the product of two blocks gives the scores of a tile. A first
pass keeps each anchor's best rows of its own label, its positives. A negative may serve a positive if its score lies between a
lower and an upper limit that the positive's score sets. The windows of an anchor's positives overlap, so their upper limits cut the scores into
disjoint slots: a second pass keeps the best rows of other labels per slot, in each tile and over all tiles, and the best below a limit
are read from its slot and the slots under it, from the highest down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, read, written

#: Rows and anchors of a tile, and anchors of one product within it (bounds memory).
BLOCK, ANCHOR_BLOCK, PRODUCT_ROWS = 8192, 1024, 64
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least and at most so many hundredths of its positive's.
LOW, HIGH = 50, 95
NONE, MOST = -(2**63), 2**63 - 1


def whole_numbers(vectors: DataFrame, label: Column, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, label, dim, codes) of usable rows, codes the components floor(256 * x) as little-endian numbers of as few bytes as hold the row's.

    Rows with a null id, label or vector, or with a null or non-finite component, are left out. Of rows that repeat a vec_id one
    counts: the smallest (label, length, codes' bytes). Components beyond 64 bits are held at the ends of that range.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for i, y, x in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "v")), strict=True):
                if i is None or y is None or x is None or None in x:
                    continue
                v = np.array(x, np.float64)
                if not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(256 * v)
                far = np.abs(v) >= 2.0**63
                codes = np.where(far, 0, v).astype(np.int64)
                codes[far] = np.where(v[far] > 0, MOST, NONE + 1)
                rows.append((i, y, len(v), packed(codes)))
            yield table(rows, vec_id=pa.int64(), label=pa.int64(), dim=pa.int32(), codes=pa.binary())

    chosen = vectors.select(F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    found = chosen.mapInArrow(run, "vec_id long, label long, dim int, codes binary")
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "codes")).alias("v")).select("vec_id", "v.label", "v.dim", "v.codes")


def packed(codes: np.ndarray) -> bytes:
    """Of 1, 2, 4 or 8 bytes a number."""
    low, high = (int(codes.min()), int(codes.max())) if len(codes) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return codes.astype(f"<i{width}").tobytes()


def unpacked(codes: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(codes, f"<i{len(codes) // dim}").astype(np.int64) if dim else np.empty(0, np.int64)


def table(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices, exact; products beyond 64 bits are held at the ends of that range."""
    largest = [max(map(abs, (int(x.min()), int(x.max())))) if x.size else 0 for x in (a, b)]
    bound = largest[0] * largest[1] * a.shape[1]
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, NONE + 1, MOST).astype(np.int64)


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores, NONE left out; ties go to the first columns."""
    if score.shape[1] > k:
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        row, column = np.nonzero((score >= kth[:, None]) & (score > NONE))
    else:
        row, column = np.nonzero(score > NONE)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class Side:
    """Rows of one side of a tile as arrays, by id."""

    def __init__(self, rows: list[tuple], dim: int):
        rows = sorted(rows, key=lambda r: r[0])
        self.ids, self.labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.codes = np.stack([unpacked(r[2], dim) for r in rows])
        self.limits = [r[3] for r in rows]


def best_of_tile(anchors: Side, rows: Side, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each anchor's slots in this tile: (anchor_id, slot, vec_id, score).

    An anchor's limits are upper limits, falling, and a lower one: slot i holds scores of other labels from above limit i + 1 (for the last
    slot from it) to limit i. Without limits there is one slot, of all other rows of its own label.
    """
    for at in range(0, len(anchors.ids), PRODUCT_ROWS):
        some = slice(at, at + PRODUCT_ROWS)
        ids, limits = anchors.ids[some], anchors.limits[some]
        score = products(anchors.codes[some], rows.codes)
        same = anchors.labels[some, None] == rows.labels[None, :]
        if limits[0] is None:
            slots = [np.where(same & (ids[:, None] != rows.ids[None, :]), score, NONE)]
        else:
            n = max(map(len, limits)) - 1
            # anchors with fewer positives have empty slots: the lower limit, less one, again
            edge = np.array([[*x[:-1], *[x[-1] - 1] * (n + 1 - len(x[:-1]))] for x in limits], np.int64)
            slots = [np.where(~same & (score <= edge[:, i, None]) & (score > edge[:, i + 1, None]), score, NONE) for i in range(n)]
        for i, s in enumerate(slots):
            r, c = best(s, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(np.full(len(r), i, np.int32)), pa.array(rows.ids[c]), pa.array(score[r, c])], names=["anchor_id", "slot", "vec_id", "score"])


def tiled(anchors: DataFrame, rows: DataFrame, k: int, blocks: int, anchor_blocks: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score): best_of_tile() of every block of anchors with every block of rows of the same length."""
    n = n_partitions(rows.sparkSession)
    block = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    columns = ("vec_id", "label", "dim", "codes", "limits")
    sides = (
        anchors.select(*columns).withColumn("a", block(anchor_blocks, 1)).withColumn("b", every(blocks)).withColumn("side", F.lit(0))
        .unionByName(rows.withColumn("limits", F.lit(None).cast("array<long>")).select(*columns).withColumn("b", block(blocks, 2)).withColumn("a", every(anchor_blocks)).withColumn("side", F.lit(1)))
    )
    tiles = sides.repartition(max(n, min(blocks * anchor_blocks, 8 * n)), "dim", "a", "b").sortWithinPartitions("dim", "a", "b", "side")

    def multiply(batches):
        def result():
            if key is not None and held[0] and held[1]:
                yield from best_of_tile(Side(held[0], key[0]), Side(held[1], key[0]), k)

        key, held = None, ([], [])
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in ("dim", "a", "b", "side", "vec_id", "label", "codes", "limits")}
            for i in range(batch.num_rows):
                now = (c["dim"][i], c["a"][i], c["b"][i])
                if now != key:
                    yield from result()
                    key, held = now, ([], [])
                held[c["side"][i]].append((c["vec_id"][i], c["label"][i], c["codes"][i], c["limits"][i]))
        yield from result()

    return tiles.mapInArrow(multiply, "anchor_id long, slot int, vec_id long, score long")


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor's slots over all tiles, read in order of (score falling, id): no slot is gathered."""

    def run(batches):
        group, seen = None, 0
        for batch in batches:
            keep = []
            for now in zip(batch.column("anchor_id").to_pylist(), batch.column("slot").to_pylist(), strict=True):
                group, seen = (now, 1) if now != group else (group, seen + 1)
                keep.append(seen <= k)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = found.repartition(n_partitions(found.sparkSession), "anchor_id").sortWithinPartitions("anchor_id", "slot", F.desc("score"), "vec_id")
    return ordered.mapInArrow(run, found.schema)


def limits_of(scores: list[int], low: int, high: int) -> list[int]:
    """The different upper limits of positives' scores, falling, and the least lower limit: whole numbers, exact."""
    return [*sorted({high * p // 100 for p in scores}, reverse=True), min(-(-low * p // 100) for p in scores)]


def hard_negatives(vectors: DataFrame, is_anchor, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row where is_anchor(id) holds: its first rows of the same label are its positives; for each of them the first rows of
    other labels whose score is at least `low` and at most `high` hundredths of the positive's. Higher scores come first, ties go to smaller
    ids. A negative positive score leaves no room between the limits. Rows with a null id, label or vector, or with null or non-finite components,
    take no part; of rows that repeat a vec_id one counts (see whole_numbers()); vectors of another length don't meet.
    Anchors without positives, and positives without negatives, have no rows; an empty table gives none; other columns are not read.
    """
    spark = vectors.sparkSession
    ready = written(whole_numbers(vectors, label, id_column, vector_column), "numbers")
    anchors = ready.where(is_anchor(F.col("vec_id")))
    blocks, anchor_blocks = max(1, -(-ready.count() // BLOCK)), max(1, -(-anchors.count() // ANCHOR_BLOCK))
    unlimited = anchors.withColumn("limits", F.lit(None).cast("array<long>"))
    chosen = written(first_of(tiled(unlimited, ready, positives, blocks, anchor_blocks), positives).drop("slot"), "positives")

    def bounds(batches):
        for batch in batches:
            yield table([(i, limits_of(s, low, high)) for i, s in zip(batch.column("anchor_id").to_pylist(), batch.column("scores").to_pylist(), strict=True)], vec_id=pa.int64(), limits=pa.list_(pa.int64()))

    limits = chosen.groupBy("anchor_id").agg(F.collect_list("score").alias("scores")).mapInArrow(bounds, "vec_id long, limits array<long>")
    limited = anchors.join(limits.hint("merge"), "vec_id")
    slots = first_of(tiled(limited, ready, negatives, blocks, anchor_blocks), negatives)
    # an anchor's positives come before its slots
    none = F.lit(-1).alias("slot")
    stream = chosen.select("anchor_id", none, "vec_id", "score").unionByName(slots).repartition(n_partitions(spark), "anchor_id").sortWithinPartitions("anchor_id", "slot", F.desc("score"), "vec_id")

    def merge(batches):
        def windows():
            out = []
            for p, score in of:
                top, floor, taken = high * score // 100, -(-low * score // 100), 0
                for v, s in ranked:  # from the highest slot down: slots above the limit are passed over
                    if s <= top and taken < negatives:
                        if s < floor:
                            break
                        taken += 1
                        out.append((anchor, p, taken, v, score, s))
            return out

        anchor, of, ranked = None, [], []
        for batch in batches:
            rows = []
            for a, slot, v, s in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "slot", "vec_id", "score")), strict=True):
                if a != anchor:
                    rows += windows()
                    anchor, of, ranked = a, [], []
                (of if slot < 0 else ranked).append((v, s))
            yield table(rows, **result)
        yield table(windows(), **result)

    result = {"anchor_id": pa.int64(), "positive_id": pa.int64(), "rank": pa.int32(), "negative_id": pa.int64(), "positive_score": pa.int64(), "negative_score": pa.int64()}
    return stream.mapInArrow(merge, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of five positives of every vector whose vec_id is divisible by 50; every seventh label is wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, label)


#: The same rows in DuckDB.
SQL = f"""with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as q from embeddings
  where label is not null and embedding is not null and list_bool_and([x is not null and isfinite(x::double) for x in embedding])),
 scored as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
 from p join scored s using (anchor_id) where not s.same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score
 qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= {NEGATIVES}"""
