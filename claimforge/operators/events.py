"""Operational error events: fingerprints, repeats, summaries, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import between_cuts, cuts_of
from . import catalogs

#: Metadata that takes part in a fingerprint.
FINGERPRINT = ("stage", "dataset", "path", "file", "table", "model_name", "feature")


def json_text(value: Column) -> Column:
    """A string as JSON writes it, null as null."""
    inside = F.to_json(F.struct(value.cast("string").alias("v")))
    return F.when(value.isNull(), "null").otherwise(F.substring(inside, 6, F.length(inside) - 6))


def fingerprint(error_code: Column, component: Column, stage: Column, metadata: Column, exception_type: Column) -> Column:
    """20 hex digits of a digest of what an event has in common with its repeats: code, component, stage, exception type and
    the metadata with few values (a map; null values and other keys, such as ids, are left out), as JSON with keys in order."""
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.try_element_at(metadata, F.lit(k)).alias("v")) for k in sorted(FINGERPRINT)))
    pairs = F.transform(F.filter(known, lambda x: x["v"].isNotNull()), lambda x: F.concat(F.lit('"'), x["k"], F.lit('": '), json_text(x["v"])))
    parts = {"component": json_text(component), "error_code": json_text(error_code), "exception_type": json_text(exception_type), "metadata": F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), "stage": json_text(stage)}
    text = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), v) for k, v in parts.items()))
    return F.substring(F.sha2(F.concat(F.lit("{"), text, F.lit("}")), 256), 1, 20)


#: What an event may also say of itself; absent columns are null.
DETAILS = {"metadata": "map<string, string>", "exception_type": "string"}


def detailed(events: DataFrame) -> DataFrame:
    """Events with all DETAILS columns."""
    return events.withColumns({c: F.lit(None).cast(t) for c, t in DETAILS.items() if c not in events.columns})


def from_table(events: DataFrame) -> DataFrame:
    """Error events of the events table: event_id, ts, component, stage, message, metadata, exception_type."""
    components = F.array(*map(F.lit, ("ingestion", "silver", "gold", "ml", "inference")))
    stages = F.array(*map(F.lit, ("load", "validate", "write")))
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    component, stage = F.get(components, (F.col("user_id") % 5).cast("int")), F.get(stages, F.pmod(k, F.lit(3)))
    missing = F.col("user_id") % 7 == 0
    metadata = F.map_from_arrays(F.array(*map(F.lit, ("claim_id", "dataset", "path"))), F.array(F.col("event_id").cast("string"), F.concat(F.lit("set"), (F.col("user_id") % 3).cast("string")), F.when(missing, F.concat(F.lit("/data/"), stage))))
    return events.where("event_type = 'error'").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), component.alias("component"), stage.alias("stage"),
        F.concat(component, F.lit(" failed at "), stage, F.when(missing, ": file not found").otherwise("")).alias("message"), metadata.alias("metadata"), F.when(missing, "FileNotFoundError").alias("exception_type"),
    )


def classified(events: DataFrame) -> DataFrame:
    """Adds error_code by message and component."""
    c, m = F.col("component"), F.lower("message")
    missing = F.contains(m, F.lit("not found")) | F.contains(m, F.lit("missing")) | F.contains(m, F.lit("no such file"))
    general = F.when(c.isin("ingestion", "bronze"), "INGEST_999").when(c == "silver", "SILVER_999").when(c == "gold", "GOLD_999").when(c.isin("ml", "training"), "ML_999").when(c.isin("inference", "dashboard"), "INFER_999").otherwise("SYSTEM_999")
    code = (
        F.when(missing, F.when(c == "ingestion", "INGEST_001").when(c == "silver", "SILVER_001").when(c == "gold", "GOLD_001").when(c == "ml", "ML_001").otherwise(general))
        .when(F.contains(m, F.lit("unknown dataset")) & (c == "ingestion"), "INGEST_005").when(F.contains(m, F.lit("row count")) | (F.contains(m, F.lit("duplicat")) & (c == "gold")), "GOLD_003")
        .when(F.contains(m, F.lit("threshold")) & c.isin("ml", "training"), "ML_005").when(F.contains(m, F.lit("calibration")) & c.isin("ml", "training"), "ML_006").otherwise(general)
    )
    return events.withColumn("error_code", code)


def keyed(events: DataFrame) -> DataFrame:
    return detailed(classified(events)).withColumn("fingerprint", fingerprint(*(F.col(c) for c in ("error_code", "component", "stage", "metadata", "exception_type"))))


def occurrences(events: DataFrame) -> DataFrame:
    """Adds occurrence (by time, then id) and is_repeated (from the second on).

    There are few fingerprints and very many events, so none is ordered in one task: events are numbered within slots of time that hold about
    equal numbers of events, bursts or not, and each slot begins after the events of its fingerprint's earlier slots, of which there are few counts. Events
    of one microsecond share a slot.
    """
    at = F.unix_micros("ts")
    dealt = between_cuts(events, F.coalesce(at, F.lit(0)), cuts_of(events, at), "_slot").withColumn("_slot", F.when(F.col("ts").isNull(), -1).otherwise(F.col("_slot")))
    counts = dealt.groupBy("fingerprint", "_slot").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("fingerprint").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("fingerprint", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    n = F.row_number().over(Window.partitionBy("fingerprint", "_slot").orderBy("ts", "event_id"))
    numbered = dealt.withColumn("_k", n).join(bases, ["fingerprint", "_slot"])
    return numbered.withColumn("occurrence", (F.col("_base") + F.col("_k")).cast("int")).withColumn("is_repeated", F.col("occurrence") >= 2).drop("_slot", "_base", "_k")


def summary(events: DataFrame) -> DataFrame:
    return events.groupBy("fingerprint", "error_code", "component", "stage").agg(F.count("*").alias("n"), F.min("ts").cast("string").alias("first_seen"), F.max("ts").cast("string").alias("last_seen"), F.max_by("message", F.struct("ts", "event_id")).alias("last_message"))


def repeated(summaries: DataFrame, at_least: int = 2, top: int = 10) -> DataFrame:
    return summaries.where(F.col("n") >= at_least).orderBy(F.desc("n"), "fingerprint").limit(top)


def enriched(events: DataFrame) -> DataFrame:
    return events.join(F.broadcast(catalogs.errors(events.sparkSession)), "error_code", "left")


def rollup(events: DataFrame) -> DataFrame:
    """errors and repeats by component, stage, code and severity: of each fingerprint's events all but the first are repeats."""
    each = enriched(events).groupBy("fingerprint", "component", "stage", "error_code", "severity").agg(F.count("*").alias("n"))
    return each.groupBy("component", "stage", "error_code", "severity").agg(F.sum("n").alias("errors"), F.sum(F.col("n") - 1).alias("repeats"))


def of_reports(report: DataFrame) -> DataFrame:
    """component, dataset, error_code of a job report's failed data sets and validation warnings (component, dataset, status, message)."""
    failed = classified(report.where("status = 'failed'")).select("component", "dataset", "error_code")
    warned = report.where("status = 'warnings'").select("component", "dataset", F.when(F.col("component") == "silver", "SILVER_002").otherwise("INGEST_002").alias("error_code"))
    return failed.unionByName(warned)


def report_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("component").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("error_code")), ",").alias("codes"))
