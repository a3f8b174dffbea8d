"""Layers, runs and the corpus sink."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimforge.sources import io, layers


def ids(spark, path):
    return sorted(r.id for r in layers.read_layer(spark, path).select("id").collect())


def test_a_layer_is_replaced_at_once_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/layer"
    layers.write_layer(spark.range(3), path)
    held = layers.read_layer(spark, path)  # began before the swap
    layers.write_layer(spark.range(3, 8), path)
    assert sorted(r.id for r in held.collect()) == [0, 1, 2] and ids(spark, path) == [3, 4, 5, 6, 7]
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        layers.write_layer(broken, path)
    with pytest.raises(ValueError, match="missing"):
        layers.write_layer(spark.range(2), path, {"id": "long", "name": "string"})
    assert ids(spark, path) == [3, 4, 5, 6, 7]
    assert len([v for v in os.listdir(tmp_path / "layer") if v.startswith("version=")]) == 2
    layers.write_layer(spark.range(1), path)
    assert ids(spark, path) == [0] and len([v for v in os.listdir(tmp_path / "layer") if v.startswith("version=")]) == 2


def test_a_layer_has_its_contracts_types_partitions_and_order(spark, tmp_path):
    path = f"file://{tmp_path}/layer"
    rows = spark.createDataFrame([(str(i) if i % 7 else "x", None if i % 5 else "true", f"p{i % 3}", i * 31 % 100, "kept") for i in range(100)], "n string, flag string, part string, at int, other string")
    layers.write_layer(rows.withColumn("ingestion_timestamp", F.lit("t")), path, {"n": "int!", "flag": "boolean!", "part": "string"}, ("part",), ("at",))
    got = layers.read_layer(spark, path)
    assert dict(got.dtypes) == {"n": "int", "flag": "boolean", "part": "string", "at": "int", "other": "string"} and got.count() == 100
    assert got.where("n is null or flag is null").count() == 0 and got.where("n = 0").count() == 15
    assert "ingestion_timestamp" in layers.read_layer(spark, path, meta=True).columns
    for r in got.select("part", F.input_file_name().alias("f"), "at").groupBy("part", "f").agg(F.collect_list("at").alias("at")).collect():
        assert r["at"] == sorted(r["at"])
    assert "PushedFilters: [" in got.where("at = 3")._jdf.queryExecution().toString() and got.where("part = 'p1'").count() == 33
    plain = f"file://{tmp_path}/plain"
    spark.range(2).write.parquet(plain)
    assert ids(spark, plain) == [0, 1]


def test_each_plan_of_a_run_runs_once(spark, tmp_path):
    """Rows are counted as they leave the source: as many as there are, for each plan."""
    passed = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    source = spark.range(0, 1000, 1, 4).mapInArrow(through, "id long")
    jobs = {
        "kept": layers.Job(lambda: source, lambda df: df.where("id >= 100"), f"file://{tmp_path}/kept", counted={"odd": F.count_if(F.col("id") % 2 == 1)}),
        "bad": layers.Job(lambda: spark.read.parquet(f"file://{tmp_path}/nowhere"), lambda df: df, f"file://{tmp_path}/bad"),
        "none": layers.Job(lambda: spark.range(0), lambda df: df, f"file://{tmp_path}/none"),
    }
    report = {r.dataset: r for r in layers.run_jobs(spark, jobs, ["bad", "other", "kept", "none"]).collect()}
    assert passed.value == 1000
    r = report["kept"]
    assert (r.status, r.rows_in, r.rows_out, r.removed, r.counted) == ("success", 1000, 900, 100, {"odd": 500})
    assert report["bad"].status == report["other"].status == "failed" and "unknown" in report["other"].message
    assert (report["none"].status, report["none"].rows_in, report["none"].rows_out) == ("success", 0, 0)
    assert layers.read_layer(spark, f"file://{tmp_path}/kept").count() == 900


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_a_corpus_is_written_whole_and_again(spark, tmp_path, scheme):
    rows = spark.createDataFrame([("a.txt", "one\n\ntwo\n"), ("b.md", "é"), ("c.txt", None), ("d.txt", "x" * 3_000_000)], "name string, text string").repartition(3)
    for _ in range(2):
        io.write_corpus(rows, f"{scheme}{tmp_path}/corpus")
    got = {r.source_name: r.text for r in io.read_corpus(spark, f"file://{tmp_path}/corpus").collect()}
    assert {k: v for k, v in got.items() if v} == {"a.txt": "one\n\ntwo\n", "b.md": "é", "d.txt": "x" * 3_000_000}
    with pytest.raises((ValueError, pa.ArrowInvalid, Exception), match="(?i)scheme|unrecognized|no such"):
        io.write_corpus(rows, "nowhere-such://x/corpus")
