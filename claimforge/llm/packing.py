"""Packing by concatenate-and-cut.

Documents become token ids plus one separator; two passes of prefix sums (within each partition, then over the
partitions' totals) give every document its offset in one endless sequence, which is cut into fixed windows.
Each piece is a boundary record: which ids of which document lie where in which window. Only the last window is
short.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, prepare, read, written
from .tokens import ranks_of_json, split_special

WINDOW = 1024
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"


@cache
def encoder(path: str):
    """A function from text to uint32 ids, as the tokenizers library gives them for this file.

    The file's merges are in the order of its ids, so ranked-merge encoding with the same pre-token pattern gives
    the same ids (tests hold it against the library); the special strings inside texts become their ids.
    """
    ranks, special = ranks_of_json(path)
    coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        parts = split_special(text, special)
        if len(parts) == 1:
            return coder.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([np.array([special[p]], np.uint32) if i % 2 else coder.encode_to_numpy(p, disallowed_special=()) for i, p in enumerate(parts)]).astype(np.uint32)

    return encode


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(part, at, doc_id, doc_tokens, ids): ids as little-endian uint32 with the separator, `at` the ids before it in its partition."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def encode(batches):
        coded, at = encoder(path), 0
        for batch in batches:
            ids = [np.append(coded(t), np.uint32(SEPARATOR)).astype("<u4") for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(before), batch.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], names=["part", "at", "doc_id", "doc_tokens", "ids"])

    return keyed(docs).withColumn("part", F.spark_partition_id()).mapInArrow(encode, "part int, at long, doc_id long, doc_tokens long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Boundary records of the packed corpus: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty texts are documents of one id (the separator). Repeated rows and repeated doc_ids are packed each
    on their own. A null doc_id stays null. An empty table gives no rows. Other columns are not read. A document longer
    than a window is cut into as many pieces as it needs. The ids are written once to the shared folder, so that lost
    executors can't renumber them; partition totals (a row per partition) are all that is gathered in one place.
    """
    prepare(docs.sparkSession)
    table = written(token_table(docs, tokenizer), "packing")
    totals = table.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    first = F.col("base") + F.col("at")
    placed = table.join(F.broadcast(bases), "part").withColumn("first", first).withColumn("sequence_id", F.explode(F.sequence(F.expr(f"first div {window}"), F.expr(f"(first + doc_tokens - 1) div {window}"))))
    start = F.greatest(F.lit(0), F.col("sequence_id") * window - F.col("first"))
    end = F.least(F.col("doc_tokens"), (F.col("sequence_id") + 1) * window - F.col("first"))
    return (
        placed.withColumn("start", start)
        .withColumn("length", end - F.col("start"))
        .select("doc_id", "start", "length", F.crc32(F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")).alias("ids_crc32"), "doc_tokens", "sequence_id", (F.col("first") + F.col("start") - F.col("sequence_id") * window).alias("offset"))
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids."""
    return pack(read(spark, sf_dir, "documents"))
