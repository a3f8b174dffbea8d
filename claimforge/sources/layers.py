"""Layers of tables: written under a contract as a new version that takes the old one's place at once, and runs that count while they write."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import META
from ..operators.quality import enforce

#: The file that names a layer's version in use; readers of the folder as Parquet pass over it.
CURRENT = "_CURRENT"
#: Versions that stay, the one in use among them: readers that began before a swap can end.
KEPT = 2


class Folder:
    """A layer's folder in whatever file system its address names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, name: str | None = None):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> str | None:
        """The version in use; None where the folder has none (or is a plain table)."""
        if not self.fs.exists(self.at(CURRENT)):
            return None
        stream = self.fs.open(self.at(CURRENT))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def use(self, version: str) -> None:
        """From now on readers get this version: the file that names it is written aside and renamed over the old one."""
        aside = f"{CURRENT}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(aside), True)
        stream.write(bytearray(version.encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.conf).rename(self.at(aside), self.at(CURRENT), options)

    def versions(self) -> list[str]:
        """All versions, the oldest first."""
        found = [s.getPath().getName() for s in self.fs.listStatus(self.at()) if s.isDirectory()]
        return sorted(v for v in found if v.startswith("version="))

    def drop(self, version: str) -> None:
        self.fs.delete(self.at(version), True)


def shaped(df: DataFrame, contract: Mapping[str, str] | None) -> DataFrame:
    """The table as its contract has it. A contracted column that is missing is an error: nothing is written then."""
    if contract is None:
        return df
    if absent := [c for c in contract if c not in df.columns]:
        raise ValueError(f"columns missing: {absent}")
    return enforce(df, dict(contract))


def write_layer(df: DataFrame, path: str, contract: Mapping[str, str] | None = None, partitions: tuple[str, ...] = (), cluster_by: tuple[str, ...] = ()) -> str:
    """Write a table as a layer's next version and put it into use; returns the version.

    Contracted columns are cast, others kept. With partitions, rows of one partition are brought together first, large ones in several files; with
    cluster_by they are sorted by these columns within files, and without partitions dealt into ranges of them, so that a reader's filters on them skip
    files. Readers see the old version until the new one is whole; a write that fails leaves it as it was. The version before stays for those who
    still read it, older ones are deleted.
    """
    out = shaped(df, contract)
    if partitions:
        out = out.hint("rebalance", *partitions)
    elif cluster_by:
        out = out.repartitionByRange(*cluster_by)
    if cluster_by:
        out = out.sortWithinPartitions(*partitions, *cluster_by)
    folder = Folder(df.sparkSession, path)
    before = folder.versions() if folder.fs.exists(folder.at()) else []
    number = int(before[-1].split("=")[1].split("-")[0]) + 1 if before else 0
    version = f"version={number:012d}-{uuid.uuid4().hex[:8]}"
    try:
        out.write.partitionBy(*partitions).parquet(f"{folder.path}/{version}")
    except Exception:
        folder.drop(version)
        raise
    folder.use(version)
    for old in [v for v in before if v != version][: max(0, len(before) + 1 - KEPT)]:
        folder.drop(old)
    return version


def read_layer(spark: SparkSession, path: str, meta: bool = False) -> DataFrame:
    """A layer's version in use, without its provenance columns (they are never read from disk) unless meta; a folder of plain Parquet is read as it is."""
    version = Folder(spark, path).current()
    df = spark.read.parquet(f"{path.rstrip('/')}/{version}" if version else path)
    return df if meta else df.drop(*META)


@dataclass(frozen=True)
class Job:
    """A data set's way from its source to its layer. counted: further numbers to take from source rows while they pass."""

    read: Callable[[], DataFrame]
    clean: Callable[[DataFrame], DataFrame]
    path: str
    contract: Mapping[str, str] | None = None
    counted: Mapping[str, Column] = field(default_factory=dict)


REPORT = "dataset string, status string, rows_in long, rows_out long, removed long, counted map<string, long>, message string"


def run_jobs(spark: SparkSession, jobs: Mapping[str, Job], names: list[str] | None = None) -> DataFrame:
    """dataset, status, rows_in, rows_out, removed, counted, message: one row a job; an unknown name or a failure stops no other.

    Rows are counted by the plan that writes the layer, while they pass, so each plan runs once. A task that is run again counts its rows again.
    """
    rows = []
    for name in list(jobs) if names is None else names:
        if name not in jobs:
            rows.append((name, "failed", None, None, None, None, f"unknown dataset {name}"))
            continue
        job, before, after = jobs[name], Observation(), Observation()
        try:
            source = job.read().observe(before, F.count("*").alias("rows"), *(c.alias(k) for k, c in job.counted.items()))
            write_layer(job.clean(source).observe(after, F.count("*").alias("rows")), job.path, job.contract)
            seen, n = dict(before.get), after.get["rows"]
            m = seen.pop("rows")
            rows.append((name, "success", m, n, m - n, seen, None))
        except Exception as e:  # noqa: BLE001 - the report is what failures are for
            rows.append((name, "failed", None, None, None, None, str(e).splitlines()[0]))
    return spark.createDataFrame(rows, REPORT)
