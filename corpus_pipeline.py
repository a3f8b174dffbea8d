"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimforge.llm import near_dedup, packing, secrets, substring_dedup, toxicity
from claimforge.llm.common import read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a model learnt from the labelled rows that aren't held out.

    Null and empty texts show no evidence and stay; repeated rows are each judged; an empty table stays empty; all columns pass through,
    whatever their names.
    """
    return toxicity.without_toxic(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, its smallest doc_id, once.

    Null and empty texts are linked with nothing and stay; of repeated rows of a doc_id one stays; rows without a doc_id all stay; an empty table
    stays empty; all columns pass through.
    """
    return near_dedup.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that an earlier document holds; every row stays.

    Null texts stay null, shorter ones as they are; different texts under one doc_id lose their own repeats only; rows without a doc_id
    stay as they are; an empty table stays empty; other columns pass through, n_chars is counted anew.
    """
    return substring_dedup.without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked; every row stays. Null texts stay null; other columns pass through, n_chars is counted anew."""
    return secrets.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. Null and empty texts are documents of one id, the separator; an empty table has no pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Most stages are no SQL that DuckDB could run; the operators of the stages are tested by themselves (see the README for what is not).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
