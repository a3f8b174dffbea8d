"""I-Match document fingerprints.

Document frequencies are counted over the whole corpus; terms whose inverse document frequency lies in a band make the
lexicon. Randomised subsets of the lexicon are drawn once, at several rates, so that short and long texts both keep a few
terms in some of them. A fingerprint holds, for each subset, the hash of a text's sorted distinct terms in it; the likeness
of two fingerprints is the share of equal hashes among the subsets where either text has a term.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, mix, n_partitions, prepare, read

#: The band of ln(documents / document frequency). Its upper end bounds the lexicon: a term in it is in at least
#: exp(-IDF_BAND[1]) of all documents, so there are at most (mean distinct terms of a document) * exp(IDF_BAND[1]) of them.
IDF_BAND = (2.0, 7.0)
#: Rates at which a subset keeps lexicon terms, and the subsets drawn at each.
RATES, PER_RATE = tuple(2.0**-i for i in range(1, 11)), 6
#: Hex digits of a subset's hash in a fingerprint.
DIGITS = 6
#: Distinct terms a task counts before it hands them on.
COUNTED = 300_000
#: Buckets of the document order per shuffle partition.
BUCKETS = 4
TERM = re.compile(r"\w+")
FIRST = -(2**63)

U64 = np.uint64
SUBSETS = U64(1) << np.arange(len(RATES) * PER_RATE, dtype=U64)[:, None]
NO_TERMS = "." * (DIGITS * len(SUBSETS))


def terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def term_hashes(found) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in found), U64, len(found))


def memberships(hashes: np.ndarray) -> np.ndarray:
    """Which randomised subsets each term is in, a bit for each subset; depends on the term alone."""
    out = np.zeros(len(hashes), U64)
    for i, rate in enumerate(r for r in RATES for _ in range(PER_RATE)):
        draw = mix(hashes ^ mix(np.array([i], U64) + U64(0x51ED27)))
        # a draw's upper 53 bits as a fraction lie below the rate, a power of two
        out |= (draw < U64(int(rate * 2**64))).astype(U64) << U64(i)
    return out


def fingerprint(h: np.ndarray, lexicon: np.ndarray, inside: np.ndarray) -> str:
    """From sorted hashes of a text's terms and the lexicon with its memberships: DIGITS hex digits for each subset, dots for a subset
    without terms; a text without lexicon terms uses all it has."""
    bits = None
    if len(lexicon) and len(h):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        known = lexicon[at] == h
        if known.any():
            h, bits = h[known], inside[at[known]]
    if not len(h):
        return NO_TERMS
    if bits is None:
        bits = memberships(h)
    subset, term = np.nonzero((bits[None, :] & SUBSETS) != 0)
    chosen = h[term].tobytes()
    ends = (np.cumsum(np.bincount(subset, minlength=len(SUBSETS))) * 8).tolist()
    return "".join([xxhash.xxh3_64_hexdigest(chosen[a:b])[-DIGITS:] if a < b else "." * DIGITS for a, b in zip([0, *ends], ends)])


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints are 1."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(0, len(a), DIGITS)]
    held = [p for p in pairs if p[0][0] != "." or p[1][0] != "."]
    return sum(x == y for x, y in held) / len(held) if held else 1.0


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> np.ndarray:
    """Sorted hashes of the terms in the band; counted over all documents, with partial counts in each task."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(term_hashes(seen).view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(terms(text))
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        yield out()

    texts = keyed(docs).select("text")
    n = texts.count()
    if not n:
        return np.empty(0, U64)
    counted = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    inside = counted.where(F.col("df").between(n * math.exp(-band[1]), n * math.exp(-band[0]))).select("term")
    return np.sort(inside.toArrow().column("term").to_numpy().astype(np.int64).view(U64))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, at, copy, doc_id, packed): rows dealt so that each meets its next one in descending doc_id.

    Buckets are ranges of doc_id; a bucket also gets a copy of the row that follows its last one (the largest of the
    nearest lower bucket that has rows; after the smallest doc_id comes the largest). Null ids come last, rows of one id
    in order of their text's digest. Texts travel compressed.
    """
    n = n_partitions(docs.sparkSession) * BUCKETS
    ordered = keyed(docs).withColumn("at", F.coalesce("doc_id", F.lit(FIRST)))
    bounds = np.unique(np.array(ordered.select(F.col("at").cast("double")).approxQuantile("at", [i / n for i in range(1, n)], 0.25 / n) or [0.0]))

    def bucket_of(at: pa.Array) -> np.ndarray:
        return np.searchsorted(bounds, at.to_numpy().astype(float), "right").astype(np.int32)

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            tie = [hashlib.blake2b(t, digest_size=8).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column("at"))), batch.column("at"), pa.array(tie, pa.binary()), batch.column("doc_id"), pa.array([squeeze.compress(t) for t in texts], pa.binary())], names=["bucket", "at", "tie", "doc_id", "packed"])

    dealt = ordered.mapInArrow(deal, "bucket int, at long, tie binary, doc_id long, packed binary")
    # one row a bucket: as many as there are partitions, times BUCKETS

    def buckets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column("at"))), batch.column("at")], names=["bucket", "at"])

    heads = sorted(map(tuple, ordered.select("at").mapInArrow(buckets, "bucket int, at long").groupBy("bucket").agg(F.max("at")).collect()))
    if not heads:
        return dealt.withColumn("copy", F.lit(0))
    follower = docs.sparkSession.createDataFrame([(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)], "at long, follower int")
    copies = dealt.join(F.broadcast(follower), "at").groupBy(F.col("follower").alias("bucket")).agg(F.min(F.struct("tie", "doc_id", "packed")).alias("r")).select("bucket", F.lit(FIRST).alias("at"), "r.tie", "r.doc_id", "r.packed", F.lit(1).alias("copy"))
    both = dealt.withColumn("copy", F.lit(0)).unionByName(copies)
    return both.repartition(n_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "copy", F.desc("at"), "tie")


def fingerprints(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row for each row.

    The edited text has its last third replaced by the start of the next document's text (descending doc_id, the largest
    after the smallest). Null and empty texts have no terms: their fingerprints are all dots, equal to each other. Repeated
    rows follow each other in order of their text's digest; a null doc_id comes after all others. An empty table gives no
    rows; a single row is its own next. Other columns are not read.
    """
    prepare(docs.sparkSession)
    known = lexicon(docs, band)
    shared = docs.sparkSession.sparkContext.broadcast((known, memberships(known)))

    def rows(batches):
        held = None
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for bucket, copy, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "packed")), strict=True):
                text = grow.decompress(packed).decode()
                mark = fingerprint(np.sort(term_hashes(terms(text))), *shared.value)
                if held and held[0] == bucket:
                    _, was, own, own_mark = held
                    third = len(own) // 3
                    edited = own[: len(own) - third] + text[:third]
                    edited_mark = fingerprint(np.sort(term_hashes(terms(edited))), *shared.value)
                    out.append((was, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                held = None if copy else (bucket, doc, text, mark)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).select("bucket", "copy", "doc_id", "packed").mapInArrow(rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(read(spark, sf_dir, "documents"))
