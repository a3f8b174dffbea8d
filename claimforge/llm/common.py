"""Shared helpers: shared-folder tables, batch sizes, word and shingle hashes."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python: texts can be very long, so batches stay short.
BATCH_ROWS = 256
#: Entries a worker-side memo may hold before it starts anew (bounds Python memory).
MEMO_ENTRIES = 400_000

#: Parts that a large group is dealt into while it is counted.
SALTS = 64

_own_folder: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Short Arrow batches, so that a batch of long texts fits into a worker (longer ones where rows are known to be short)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); an own one only in local mode where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-shared-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return _own_folder[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discarded(*frames: DataFrame) -> None:
    """Delete the folders of written() frames that nothing reads any more."""
    for df in frames:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames no longer referred to: Spark removes them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_copies(pairs: DataFrame, share: int, *carried: str, pivots: dict[str, tuple[Callable, str]] | None = None) -> DataFrame:
    """(doc_id, part, roles array<struct<pivot, copy, is_member>>) from (doc_id, pivot) pairs: where a text has to go so that every
    member meets its pivot under one (pivot, copy).

    A pivot has a copy for every `share` of its members, or for the square root of their number if that is more, so neither the copies
    nor what meets one of them outgrows a task. Members are counted by (pivot, salt), so no task holds a whole group.
    Carried columns go into the members' roles; in the pivots' they are null, or the least or largest value of a column of the members,
    as `pivots` says (F.min or F.max, column).
    """
    reduced = {f"of_pivot_{c}": (f, F.col(of)) for c, (f, of) in (pivots or {}).items()}
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("pivot", "salt").agg(F.count("*").alias("n"), *[f(x).alias(c) for c, (f, x) in reduced.items()])
    copies = F.ceil(F.col("n") / F.greatest(F.lit(share), F.sqrt("n"))).alias("copies")
    totals = counts.groupBy("pivot").agg(F.sum("n").alias("n"), *[f(c).alias(c) for c, (f, _) in reduced.items()]).select("pivot", copies, *reduced)
    per_salt = counts.select("pivot", "salt").join(totals.hint("merge"), "pivot").select("pivot", "salt", "copies")
    of = lambda copy, is_member, extra: F.struct("pivot", copy.alias("copy"), F.lit(is_member).alias("is_member"), *extra).alias("role")
    types = dict(pairs.dtypes)
    member = salted.join(per_salt.hint("merge"), ["pivot", "salt"]).select("doc_id", F.lit(0).cast("long").alias("part"), of(F.pmod(F.xxhash64("doc_id", F.lit(7)), "copies"), True, carried))
    pivot = totals.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("c"), *reduced).select(F.col("pivot").alias("doc_id"), F.expr(f"c div {SALTS}").alias("part"), of(F.col("c"), False, [(F.col(f"of_pivot_{c}") if c in (pivots or {}) else F.lit(None)).cast(types[c]).alias(c) for c in carried]))
    return member.unionAll(pivot).groupBy("doc_id", "part").agg(F.collect_list("role").alias("roles"))


def keyed(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text) of a documents table, null texts as empty; other columns never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lowered: bytes.lower and bytes.split are ASCII-only, exactly that."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def batch_shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): shingle_hashes() of several texts at once, end to end; text i has hashes[bounds[i] : bounds[i + 1]]."""
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    w = word_hashes(chain.from_iterable(words))
    ends = np.cumsum(n)
    begins = ends - n
    count = np.where(n > 0, np.maximum(1, n - k + 1), 0)
    bounds = np.r_[0, np.cumsum(count)]
    at = np.arange(bounds[-1]) + np.repeat(begins - bounds[:-1], count)
    span = np.repeat(np.minimum(k, n), count)
    h = span.astype(np.uint64)
    short = span < k
    for i in range(k):
        grown = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[np.minimum(at + i, len(w) - 1)]) if len(w) else h
        h = np.where(short & (i >= span), h, grown) if short.any() else grown
    return h, bounds


def passes(texts: list[str], chars: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of about so many characters together (a longer text has its own): bounds what is held at once."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > chars:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def shingles_of(texts: list[str], k: int = 5) -> Iterator[np.ndarray]:
    """The shingles of each text in order."""
    for some in passes(texts):
        h, bounds = batch_shingles(texts[some], k)
        yield from (h[a:b].copy() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def shingle_hashes(words: list[bytes], k: int = 5) -> np.ndarray:
    """Hash of each run of k words in order; with fewer words, one hash of the whole sequence; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    n, span = max(1, len(w) - k + 1), min(k, len(w))
    h = np.full(n, span, np.uint64)
    for i in range(span):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return h
