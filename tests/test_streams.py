"""Streams against their batch twins, over restarts, repeated batches and late files."""

import random

from pyspark.sql import functions as F

from claimforge.operators import events as E
from claimforge.streaming import streams

EVENT = "event_id long, ts timestamp, component string, stage string, message string, metadata map<string, string>, exception_type string"


def made(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, r.randrange(10_000), r.choice(["gold", "ml", "silver"]), r.choice(["load", "write"]), f"m{i}", {"dataset": r.choice(["a", "b"]), "claim_id": str(i)}, r.choice([None, "ValueError"])) for i in range(n)]
    rows += [(n + i, 5000, "gold", "load", "same time", {"dataset": "a"}, None) for i in range(20)]
    return spark.createDataFrame(rows, EVENT.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))


def test_fingerprints_by_what_repeats_share(spark):
    base = (1, 0, "gold", "load", "m", {"dataset": "a", "claim_id": "1", "path": None}, None)
    others = [(2, 5, "gold", "load", "other message", {"claim_id": "2", "dataset": "a"}, None), (3, 0, "gold", "load", "m", {"dataset": "b"}, None), (4, 0, "gold", "load", "m", {"dataset": "a", "path": "p"}, None), (5, 0, "gold", "load", "m", {"dataset": "a"}, "KeyError"), (6, 0, "gold", "write", "m", {"dataset": "a"}, None), (7, 0, "gold", "load", "m", None, None)]
    df = spark.createDataFrame([base, *others], EVENT.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    got = {r.event_id: r.fingerprint for r in E.keyed(df).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 6 and all(len(f) == 20 for f in got.values())
    assert E.keyed(df.drop("metadata", "exception_type").where("event_id = 1")).first().fingerprint == got[7]
    odd = spark.createDataFrame([(1, 0, "gold", 'l"o\\ad', "m", {"dataset": 'q"é\n'}, None)], EVENT.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    assert len(E.keyed(odd).first().fingerprint) == 20


def run(spark, parts, folder, start, **how):
    """Each part arrives as files of its own, and the stream is started anew for it."""
    for i, part in enumerate(parts):
        part.repartition(2).write.mode("append").parquet(f"{folder}/in")
        start(streams.file_stream(spark, f"{folder}/in", part.schema, 1 + i % 2), f"{folder}/out", f"{folder}/checkpoint", **how).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_occurrences_as_the_batch_numbers_them(spark, tmp_path):
    events = made(spark, 300)
    end = events.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.timestamp_seconds(F.lit(10**6)), "stage": F.lit("end")})
    parts = [events.where(F.col("event_id") % 3 == k) for k in (2, 0, 1)]
    out = run(spark, [*parts, end], f"file://{tmp_path}", streams.start_occurrences, delay="4 hours")
    got = sorted(map(tuple, out.where("event_id >= 0").select("event_id", "fingerprint", "occurrence", "is_repeated", "ts").collect()))
    want = sorted(map(tuple, E.occurrences(E.keyed(events)).select("event_id", "fingerprint", "occurrence", "is_repeated", "ts").collect()))
    assert got == want and len(got) == 320


def test_what_comes_later_than_the_delay_is_dropped_and_numbers_stay(spark, tmp_path):
    at = lambda i, second: spark.createDataFrame([(i, second, "gold", "load", "m", None, None)], EVENT.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    parts = [at(1, 100), at(2, 5000), at(3, 200), at(4, 9000), at(5, 10**6)]
    out = run(spark, parts, f"file://{tmp_path}", streams.start_occurrences, delay="10 minutes")
    assert sorted((r.event_id, r.occurrence) for r in out.collect()) == [(1, 1), (2, 2), (4, 3)]


def test_summaries_by_key_and_a_batch_that_is_tried_again(spark, tmp_path):
    events = made(spark, 200, 2)
    parts = [events.where(F.col("event_id") % 2 == k) for k in (0, 1)]
    run(spark, parts, f"file://{tmp_path}", streams.start_summary)
    columns = ["fingerprint", "error_code", "component", "stage", "n", "last_message"]
    want = sorted(map(tuple, E.summary(E.keyed(events)).select(columns).collect()))
    got = streams.read_summary(spark, f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.select(columns).collect())) == want
    last = spark.read.parquet(f"file://{tmp_path}/out").agg(F.max("batch")).first()[0]
    written = spark.read.parquet(f"file://{tmp_path}/out/batch={last}")
    again = spark.createDataFrame(written.collect(), written.schema)
    streams.into_batches(f"file://{tmp_path}/out")(again, last)
    assert sorted(map(tuple, streams.read_summary(spark, f"file://{tmp_path}/out").select(columns).collect())) == want
