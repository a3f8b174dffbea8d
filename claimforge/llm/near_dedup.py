"""MinHash near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union-find.

Documents with the same shingle set are one class (its smallest doc_id stands for it). Signatures of the classes are
banded. First every class is held against the smallest id of each of its buckets. Two exact bounds (set sizes, parity sketches)
say which pairs can be links; these are confirmed on the full sets and grouped by union-find. Then members of one bucket that still lie
in different components are held against each other, all of them, in tiles, behind the same bounds, and what is found is confirmed and grouped too.
So a link is lost only if its sets share none of the bands: at the threshold a chance of (1 - 0.85^4)^32, under 1e-10. Sets are compared as
sets of 64-bit hashes of their shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, dealt_copies, discarded, keyed, mix, n_partitions, prepare, read, released, shingles_of, written
from .components import components

U64 = np.uint64

SHINGLE_WORDS = 5
#: Signature length, and the rows and number of the bands cut from it.
SIGNATURE = 128
BANDS = (4, 32)
SIMILARITY = (85, 100)
#: Shingles of one signature pass: bounds the memory of its permutation table.
PASS_SHINGLES = 1 << 15
#: Members of a group that one copy of a pivot's set serves, at least.
PIVOT_SHARE = 512
#: Bits of a set's parity sketch, and rows of a bucket on each side of a tile; rows and pairs of a tile that are compared at once.
PARITY_BITS, TILE = 1024, 4096
TILE_ROWS, TILE_PAIRS = 256, 1 << 17


def superminhash(sets: list[np.ndarray], m: int = SIGNATURE) -> np.ndarray:
    """SuperMinHash (Ertl 2017) of several sets of distinct hashes: an array (sets, m) of uint64.

    Every element walks a random permutation of the m places; at step j it offers j plus a random fraction to the
    place it comes to, so an element's ranks at different places are correlated (all different), which lowers the
    variance. A set stops at step j as soon as all its places hold less than j. All sets take their steps
    together; the fraction is kept in 32 bits below the step's number. An empty set's places stay at the maximum.
    """
    out = np.full((len(sets), m), ~U64(0))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return out
    element = np.concatenate(sets).astype(U64)
    flat = out.reshape(-1)
    walk = np.tile(np.arange(m, dtype=np.int16), (len(element), 1))
    row = np.arange(len(element))
    for j in range(m):
        if j:
            open_sets = out.max(axis=1) >= U64(j << 32)
            keep = open_sets[owner]
            if not keep.any():
                break
            if not keep.all():
                owner, element, walk = owner[keep], element[keep], walk[keep]
                row = np.arange(len(element))
        random = mix(element + U64(((j + 1) * 0x9E3779B97F4A7C15) % 2**64))
        k = j + ((random >> U64(32)) % U64(m - j)).astype(np.int64)
        place = walk[row, k].astype(np.int64)
        walk[row, k] = walk[:, j]
        np.minimum.at(flat, owner * m + place, (U64(j) << U64(32)) | (random & U64(0xFFFFFFFF)))
    return out


def signatures(sets: list[np.ndarray], m: int = SIGNATURE) -> np.ndarray:
    """superminhash() in passes of bounded size; a larger set has a pass (or, in parts that merge by minimum, several) of its own."""
    out, batch, size = np.full((len(sets), m), ~U64(0)), [], 0

    def flush() -> None:
        if batch:
            found = superminhash([s for _, s in batch], m)
            for (i, _), row in zip(batch, found, strict=True):
                np.minimum(out[i], row, out=out[i])

    for i, s in enumerate(sets):
        for part in [s[a : a + PASS_SHINGLES] for a in range(0, len(s), PASS_SHINGLES)]:
            if size + len(part) > PASS_SHINGLES:
                flush()
                batch, size = [], 0
            batch.append((i, part))
            size += len(part)
    flush()
    return out


def band_hashes(signature: np.ndarray, bands: tuple[int, int] = BANDS) -> np.ndarray:
    """One 64-bit hash for each band of each signature."""
    rows, n = bands
    at = signature[:, : rows * n].reshape(len(signature), n, rows)
    h = np.tile(mix(np.arange(n, dtype=U64) + U64(rows << 32)), (len(signature), 1))
    for r in range(rows):
        h = mix(h * U64(0x9E3779B97F4A7C15) + at[:, :, r])
    return h


def parity_of(s: np.ndarray) -> np.ndarray:
    """Bits that each shingle flips one of: two sets differ in at least as many shingles as their sketches in bits."""
    flips = np.bincount((s >> U64(32)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash binary, bands array<long>, parity array<long>) of every row."""

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1).view(np.int64)))

    def run(batches):
        for batch in batches:
            sets = list(map(np.unique, shingles_of(batch.column("text").to_pylist(), SHINGLE_WORDS)))
            n = np.array([len(s) for s in sets], np.int64)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            parity = np.array([parity_of(s) for s in sets], np.int64).reshape(-1, PARITY_BITS // 64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(digest, pa.binary()), lists(band_hashes(signatures(sets))), lists(parity)], names=["doc_id", "n_shingles", "set_hash", "bands", "parity"])

    return keyed(docs).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, parity array<long>")


def similar(a: np.ndarray, b: np.ndarray, at_least: tuple[int, int] = SIMILARITY) -> bool:
    """Whether two sorted sets have 100 * intersection >= 85 * union."""
    num, den = at_least
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, at_least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The (member, pivot) pairs whose full sets are similar enough.

    A pivot's text meets its members' texts (compressed, made into sets where they meet) in one task as a stream: the pivot
    first, then one member at a time. A pivot with many members is copied, so a large group is spread over tasks. An id with
    several texts is similar to what one of them is similar to.
    """
    n = n_partitions(docs.sparkSession)
    roles = dealt_copies(pairs.withColumnRenamed("member", "doc_id"), PIVOT_SHARE)
    texts = keyed(docs).join(roles.hint("merge"), "doc_id")

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed, batch.column("roles")], names=["doc_id", "packed", "roles"])

    dealt = (
        texts.mapInArrow(squeeze, "doc_id long, packed binary, roles array<struct<pivot: long, copy: long, is_member: boolean>>")
        .select("doc_id", "packed", F.explode("roles").alias("r"))
        .select("doc_id", "packed", "r.pivot", "r.copy", "r.is_member")
        .repartition(n, "pivot", "copy")
        .sortWithinPartitions("pivot", "copy", "is_member")
    )

    def verify(batches):
        grow = zstandard.ZstdDecompressor()
        held: list[np.ndarray] = []
        of = None
        for batch in batches:
            member, found = [], []
            sets = map(np.unique, shingles_of([grow.decompress(p).decode("utf-8", "surrogatepass") for p in batch.column("packed").to_pylist()], SHINGLE_WORDS))
            for s, doc, pivot, copy, is_member in zip(sets, *(batch.column(c).to_pylist() for c in ("doc_id", "pivot", "copy", "is_member")), strict=True):
                if of != (pivot, copy):
                    held, of = [], (pivot, copy)
                if not is_member:
                    held.append(s)
                elif any(similar(s, h, at_least) for h in held):
                    member.append(doc)
                    found.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(member, pa.int64()), pa.array(found, pa.int64())], names=["member", "pivot"])

    return dealt.mapInArrow(verify, "member long, pivot long")


def class_members(known: DataFrame) -> DataFrame:
    """(doc_id, class): the smallest id that has the same set; distinct rows. Minima go by (set, salt) first and come back so, so
    that no task holds all copies of one text."""
    salted = known.select("doc_id", "set_hash", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = salted.groupBy("set_hash", "salt").agg(F.min("doc_id").alias("class"))
    smallest = parts.groupBy("set_hash").agg(F.min("class").alias("class"))
    per_salt = parts.select("set_hash", "salt").join(smallest.hint("merge"), "set_hash")
    return salted.join(per_salt.hint("merge"), ["set_hash", "salt"]).select("doc_id", "class").distinct()


def crowded_rows(classes: DataFrame) -> DataFrame:
    """(band, doc_id, pivot): the rows of buckets that hold more than one id, with the bucket's smallest.

    Counts and minima are taken map-side; the join back may be split where a bucket is large.
    """
    rows = classes.select("doc_id", F.explode("bands").alias("band"))
    pivots = rows.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot <> last").select("band", "pivot")
    return rows.join(pivots.hint("merge"), "band")


def mixed_rows(crowded: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, doc_id, n_shingles, parity, component, is_main, tiles, other_tiles): the rows of buckets that hold more than one component.

    is_main tells the bucket's largest component; tiles and other_tiles count the tiles of all its rows and of those outside the largest.
    """
    rows = crowded.select("band", "doc_id").join(groups.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = rows.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("main")).where("total > main.n")
    tiles = lambda c: F.ceil(c / TILE).cast("int")
    mixed = rows.join(sizes.hint("merge"), "band").select("band", "doc_id", "component", (F.col("component") == F.col("main.component")).alias("is_main"), tiles(F.col("total")).alias("tiles"), tiles(F.col("total") - F.col("main.n")).alias("other_tiles"))
    return mixed.join(classes.select("doc_id", "n_shingles", "parity").hint("merge"), "doc_id")


def possible(pairs: DataFrame, classes: DataFrame, at_least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The (member, pivot) pairs whose sizes and parity sketches allow the similarity: both are bounds, so no similar pair is lost, and no text moves
    for the others. An id with several texts stays with a pivot if one of them may be like it."""
    num, den = at_least
    of = lambda name, short: classes.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"{short}_n"), F.col("parity").alias(f"{short}_parity")).hint("merge")
    met = pairs.join(of("member", "m"), "member").join(of("pivot", "p"), "pivot")
    differ = sum((F.bit_count(F.col("m_parity")[k].bitwiseXOR(F.col("p_parity")[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
    sizes = num * F.greatest("m_n", "p_n") <= den * F.least("m_n", "p_n")
    return met.where(sizes & ((den + num) * differ <= (den - num) * (F.col("m_n") + F.col("p_n")))).select("member", "pivot").distinct()


class TileSide:
    """Rows of one side of a tile as arrays."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.sizes, self.components = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.is_main = np.array([r[3] for r in rows], bool)
        self.parity = np.array([r[4] for r in rows], np.int64).view(U64).reshape(len(rows), -1)


def tile_pairs(x: TileSide, y: TileSide, nearest_only: bool, at_least: tuple[int, int] = SIMILARITY):
    """Record batches (doc_id, other, distance): pairs of y with x in different components that can be similar enough; with nearest_only the nearest of
    each row of y."""
    num, den = at_least
    for at in range(0, len(y.ids), TILE_ROWS):
        some = slice(at, at + TILE_ROWS)
        n = y.sizes[some, None]
        fit = (y.components[some, None] != x.components) & (x.is_main | (x.ids < y.ids[some, None])) & (num * np.maximum(n, x.sizes) <= den * np.minimum(n, x.sizes))
        row, column = np.nonzero(fit)
        found = []
        for part in range(0, len(row), TILE_PAIRS):
            r, c = row[part : part + TILE_PAIRS], column[part : part + TILE_PAIRS]
            differ = np.bitwise_count(y.parity[some][r] ^ x.parity[c]).sum(axis=1, dtype=np.int64)
            both = y.sizes[some][r] + x.sizes[c]
            near = (den + num) * differ <= (den - num) * both
            found.append((y.ids[some][r][near], x.ids[c][near], (differ / both)[near]))
        if not found:
            continue
        ids, others, distance = (np.concatenate(v) for v in zip(*found, strict=True))
        if nearest_only:
            order = np.lexsort((others, distance, ids))
            first = order[np.unique(ids[order], return_index=True)[1]]
            ids, others, distance = ids[first], others[first], distance[first]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(distance)], names=["doc_id", "other", "distance"])


def mixed_pairs(mixed: DataFrame, nearest_only: bool, at_least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, other): pairs of rows of one bucket in different components that can be similar enough, or each row's nearest of them.

    All rows meet those outside the bucket's largest component, tile by tile, behind bounds by sizes and sketches' differing bits.
    """
    n = n_partitions(mixed.sparkSession)
    tile = lambda of, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    columns = ("doc_id", "n_shingles", "component", "is_main", "parity")
    x = mixed.select("band", *columns, F.lit(0).alias("side"), tile(F.col("tiles"), 1).alias("i"), every(F.col("other_tiles")).alias("j"))
    y = mixed.where("not is_main").select("band", *columns, F.lit(1).alias("side"), tile(F.col("other_tiles"), 2).alias("j"), every(F.col("tiles")).alias("i"))
    tiles = x.unionByName(y).repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", "side")

    def meet(batches):
        at, held = None, ([], [])
        for batch in batches:
            keys, side = zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j")), strict=True), batch.column("side").to_pylist()
            values = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            for now, s, row in zip(keys, side, values, strict=True):
                if now != at:
                    if held[0] and held[1]:
                        yield from tile_pairs(*map(TileSide, held), nearest_only, at_least)
                    at, held = now, ([], [])
                held[s].append(row)
        if held[0] and held[1]:
            yield from tile_pairs(*map(TileSide, held), nearest_only, at_least)

    near = tiles.mapInArrow(meet, "doc_id long, other long, distance double")
    if nearest_only:
        near = near.groupBy("doc_id").agg(F.min(F.struct("distance", "other")).alias("least")).select("doc_id", "least.other")
    return near.select("doc_id", "other")


def near_duplicates(docs: DataFrame, at_least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row of documents.

    Texts without words (null and empty ones too) have an empty set and are linked with nothing. Rows with a null doc_id
    are returned as they are, unlinked and kept. Repeated rows of one doc_id are all returned, with the same component; if
    their texts differ, the id is linked with what either of them is linked with. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    table = written(sketches(docs), "sketches")
    known = table.where("doc_id is not null and n_shingles > 0")
    members = written(class_members(known), "members")
    classes = written(known.join(members.where("doc_id = class").select("doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "set_hash"]).select("doc_id", "n_shingles", "bands", "parity"), "classes")
    crowded = written(crowded_rows(classes), "crowded")
    released(spark)
    pairs = written(possible(crowded.where("doc_id <> pivot").select(F.col("doc_id").alias("member"), "pivot").distinct(), classes, at_least), "pairs")
    # an id with several texts is in several classes
    several = members.groupBy("doc_id").agg(F.collect_set("class").alias("of")).where("size(of) > 1").select(F.col("doc_id").alias("member"), F.explode("of").alias("pivot"))
    links = written(confirmed(pairs, docs, at_least).unionAll(several), "links")
    released(spark)
    groups = components(links, "member", "pivot")
    for nearest_only in (True, False):  # each row's nearest first, so that few pairs are left when all are taken
        mixed = written(mixed_rows(crowded, classes, groups), "mixed")
        near = mixed_pairs(mixed, nearest_only, at_least)
        pairs = written(near.select(F.greatest("doc_id", "other").alias("member"), F.least("doc_id", "other").alias("pivot")).distinct(), "pairs")
        discarded(mixed)
        released(spark)
        if pairs.isEmpty():
            break
        links = written(confirmed(pairs, docs, at_least).unionAll(groups.select(F.col("id").alias("member"), F.col("component").alias("pivot"))), "links")
        groups = components(links, "member", "pivot")
        released(spark)
    discarded(classes, crowded)
    placed = members.join(groups.withColumnRenamed("id", "class").hint("merge"), "class", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "class")).alias("component"))
    return (
        table.select("doc_id", "n_shingles").join(placed.hint("merge"), "doc_id", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of documents, all columns, with one document of each near-duplicate group (its smallest doc_id), once; rows
    with a null doc_id all stay."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))
