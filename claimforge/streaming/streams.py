"""Streams: incremental error summaries and claim intake over arriving files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import events as E
from ..operators import intake


def error_counts(stream: DataFrame) -> DataFrame:
    """Running summary by fingerprint. Its state holds a row for each distinct fingerprint, whose fields have few values."""
    return E.keyed(stream).groupBy("fingerprint", "error_code", "component", "stage").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("message", F.struct("ts", "event_id")).alias("last_message"))


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def into_batches(out: str):
    """A sink that writes each batch into a folder named by its number: one that is tried again overwrites its own rows and no others."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def start_summary(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, in as many batches as it takes; each batch writes the summaries that it changed (see read_summary())."""
    return error_counts(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(into_batches(out)).start()


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    """The last summary of each fingerprint."""
    rows = spark.read.parquet(out)
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("fingerprint").agg(F.max_by(F.struct(*names), "batch").alias("x")).select("x.*")


OCCURRENCE = "event_id long, ts timestamp, fingerprint string, occurrence long, is_repeated boolean"


def occurrences(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The events of a stream with their occurrence number by time, then id, and is_repeated: operators.events.occurrences() as events arrive.

    Events may come out of order by at most the delay. A fingerprint's state is the number of events that have got theirs and the events
    that the watermark hasn't passed yet, so it is bounded by what occurs within the delay. An event is handed on once, when no earlier one can come;
    those that come later than the delay are dropped, as a watermark does.
    """
    events = E.keyed(stream).withWatermark("ts", delay).select("fingerprint", "ts", F.unix_micros("ts").alias("at"), "event_id")

    def number(key, frames, state):
        n, at, ids = state.get if state.exists else (0, [], [])
        waiting = list(zip(at, ids, strict=True))
        for f in frames:
            waiting += zip(f["at"].tolist(), f["event_id"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [x for x in waiting if x[0] <= passed]
        rest = waiting[len(ready) :]
        state.update((n + len(ready), [x[0] for x in rest], [x[1] for x in rest]))
        if rest:  # when the watermark passes the first of them
            state.setTimeoutTimestamp(max(rest[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if ready:
            order = range(n + 1, n + 1 + len(ready))
            yield pd.DataFrame({"event_id": [x[1] for x in ready], "ts": pd.to_datetime([x[0] for x in ready], unit="us"), "fingerprint": key[0], "occurrence": order, "is_repeated": [k >= 2 for k in order]})

    return events.groupBy("fingerprint").applyInPandasWithState(number, OCCURRENCE, "n long, at array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def start_occurrences(stream: DataFrame, out: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """All that has arrived and the watermark has passed, a folder for each batch."""
    return occurrences(stream, delay).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(into_batches(out)).start()


def start_intake(stream: DataFrame, lookups: dict[str, DataFrame], out: str, checkpoint: str, scorer=intake.rule_score) -> StreamingQuery:
    """Every arriving claim validated, built and scored against static lookup tables, by a fitted model where scorer has one. A batch goes to a folder named by its
    number, overwritten when it is tried again, so a restart duplicates nothing."""
    def write(df: DataFrame, batch: int) -> None:
        intake.score(df, lookups, scorer).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
