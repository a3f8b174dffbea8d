"""Reading and writing: CSV with provenance, text corpora, JSON lines."""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import na_to_null

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
#: Registered data sets: file name and columns (read as text; typed when cleaned).
DATASETS = {
    "claims": ("claims.csv", T.StructType(_text("claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "date", "denial_flag"))),
    "providers": ("providers.csv", T.StructType(_text("provider_id", "doctor_name", "specialty", "location"))),
    "diagnosis": ("diagnosis.csv", T.StructType(_text("diagnosis_code", "category", "severity"))),
    "cost": ("cost.csv", T.StructType(_text("procedure_code", "average_cost", "expected_cost", "region"))),
}
EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), *_text("component", "stage", "message"), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("exception_type", T.StringType())])


def read_csv(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """A registered CSV data set; an unregistered name or a missing file is an error. Null tokens become nulls."""
    name, schema = DATASETS[dataset]
    df = spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}")
    return df.select(*(na_to_null(F.col(c)).alias(c) for c in df.columns), F.col("_metadata.file_name").alias("source_file"))


def with_provenance(df: DataFrame, run_at: str, source: str | None = None) -> DataFrame:
    out = df.withColumn("ingestion_timestamp", F.lit(run_at).cast("timestamp"))
    return out if source is None else out.withColumn("source_file", F.lit(source))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, source_name, text: whole text and markdown files, found recursively; files that can't be read are skipped."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,markdown}").option("ignoreCorruptFiles", True).text(folder, wholetext=True)
    name = F.col("_metadata.file_name")
    return df.select(F.substring(F.sha2(name, 256), 1, 16).alias("document_id"), name.alias("source_name"), F.col("value").alias("text"))


def write_corpus(rows: DataFrame, folder: str) -> None:
    """Each row's text as a file of its own, <folder>/<two letters>/<name>, in any file system that Arrow knows (file, hdfs, s3, gs ...).

    Tasks write aside and rename, so one that is run again, or twice at once, leaves one whole file. A folder without a scheme is a path
    that all executors share. Null texts are empty; rows without a name are an error.
    """
    address = folder if urlsplit(folder).scheme else f"file://{folder}"
    if address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address[len("file:") :]

    def run(batches):
        store, root = FileSystem.from_uri(address)
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                place = f"{root}/{hashlib.sha256(name.encode()).hexdigest()[:2]}"
                aside = f"{place}/.{uuid.uuid4().hex}"
                store.create_dir(place, recursive=True)
                with store.open_output_stream(aside) as f:
                    f.write((text or "").encode("utf-8", "surrogatepass"))
                store.move(aside, f"{place}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("name", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENT).json(folder)
