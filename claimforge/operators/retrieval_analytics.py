"""Analytics over policy matches (claim_id, reason_code, policy_chunk_id, source_name, section_title, similarity_score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantiles_of_counts
from .projection import projected

KEYS = ("claim_id", "reason_code", "policy_chunk_id", "source_name", "section_title")
SAMPLE_ROWS = 1500


def first_by(df: DataFrame, keys, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe(matches: DataFrame) -> DataFrame:
    """One row a key, the best score; a null score counts as -1. A claim's rows travel together: what they share is packed."""
    return first_by(matches.repartition("claim_id"), KEYS, F.desc(F.coalesce("similarity_score", F.lit(-1.0))))


def source_utilisation(chunks: DataFrame, matches: DataFrame) -> DataFrame:
    """Chunks, retrievals, distinct chunks retrieved, rate and mean similarity of every source, unused ones too."""
    c = chunks.groupBy("source_name").agg(F.count_distinct("chunk_id").alias("policy_chunks"))
    m = dedupe(matches).groupBy("source_name").agg(F.count("*").alias("retrieval_count"), F.count_distinct("policy_chunk_id").alias("unique_chunks_retrieved"), F.round(F.avg("similarity_score"), 4).alias("avg_similarity"))
    return c.join(m, "source_name", "left").na.fill(0, ["retrieval_count", "unique_chunks_retrieved"]).withColumn("utilization_rate", F.round(F.col("unique_chunks_retrieved") / F.col("policy_chunks"), 4))


def reason_source_flow(matches: DataFrame, top: int = 50) -> DataFrame:
    return dedupe(matches).groupBy(F.col("reason_code").alias("reason"), F.col("source_name").alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason", "source").limit(top)


def all_sources(chunks: DataFrame, matches: DataFrame) -> DataFrame:
    return chunks.select("source_name").unionByName(matches.select("source_name")).distinct()


def reason_coverage(explanations: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct (claim, reason) keys, how many were matched, the rate, mean similarity and the most frequent source."""
    rows = explanations.groupBy("reason_code").agg(F.count_distinct("claim_id").alias("reason_rows"))
    m = dedupe(matches)
    found = m.groupBy("reason_code").agg(F.count_distinct("claim_id").alias("matched_rows"), F.round(F.avg("similarity_score"), 4).alias("avg_similarity"))
    mode = first_by(m.groupBy("reason_code", "source_name").count(), ["reason_code"], F.desc("count"), "source_name").select("reason_code", F.col("source_name").alias("top_policy_source"))
    out = rows.join(found, "reason_code", "left").join(mode, "reason_code", "left").na.fill(0, ["matched_rows"]).na.fill("—", ["top_policy_source"])
    return out.withColumn("match_rate", F.round(F.col("matched_rows") / F.col("reason_rows"), 4))


def top_chunks(chunks: DataFrame, matches: DataFrame, top: int = 20) -> DataFrame:
    m = dedupe(matches).groupBy("policy_chunk_id").agg(F.count("*").alias("retrieval_count"), F.round(F.avg("similarity_score"), 4).alias("avg_similarity"))
    return m.orderBy(F.desc("retrieval_count"), "policy_chunk_id").limit(top).join(chunks.select(F.col("chunk_id").alias("policy_chunk_id"), "source_name", F.substring("chunk_text", 1, 220).alias("snippet")), "policy_chunk_id", "left")


def projection(vectors: DataFrame, matches: DataFrame, rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """vec_id, x, y, retrievals: rows on the two principal components of all rows; a seeded sample of them for display (all, if rows is None)."""
    shown = vectors if rows is None else vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows)
    xy = projected(vectors).join(shown.select("vec_id"), "vec_id", "left_semi")
    n = matches.groupBy(F.col("policy_chunk_id").alias("vec_id")).agg(F.count("*").alias("retrievals"))
    return xy.join(n, "vec_id", "left").select("vec_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), F.coalesce("retrievals", F.lit(0)).alias("retrievals"))


def strength(explanations: DataFrame, matches: DataFrame) -> DataFrame:
    """Model contribution beside the best policy similarity of each (claim, reason)."""
    e = first_by(explanations, ["claim_id", "reason_code"], F.desc(F.abs("shap_value")))
    best = matches.groupBy("claim_id", "reason_code").agg(F.max("similarity_score").alias("best_similarity"))
    return e.join(best, ["claim_id", "reason_code"]).select("claim_id", "reason_code", F.abs("shap_value").alias("model_strength"), "best_similarity")


def similarity_quartiles(matches: DataFrame, top: int = 12, write=lambda df, name: df) -> DataFrame:
    """Quartiles of similarity of the most frequent reasons. The count of each reason's scores, which is read more than once, goes through
    write(frame, name), which may put it into a table and return that."""
    m = dedupe(matches.select(*KEYS, "similarity_score"))
    counted = write(m.groupBy("reason_code", F.col("similarity_score").cast("double").alias("v")).agg(F.count("*").alias("n")), "similarities")
    often = counted.groupBy("reason_code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "reason_code").limit(top).select("reason_code")
    known = counted.where(F.col("reason_code").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    p = quantiles_of_counts(known.join(often, "reason_code", "left_semi"), ("reason_code",), q1=0.25, median=0.5, q3=0.75)
    return p.select("reason_code", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")))


def similarity_histogram(matches: DataFrame, bins: int = 30) -> DataFrame:
    """bin, n of similarities between 0 and 1."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.round(F.col("similarity_score") * bins, 6)).cast("int")))
    return dedupe(matches).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def kpis(chunks: DataFrame, matches: DataFrame, explanations: DataFrame) -> DataFrame:
    c = chunks.agg(F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("source_name").alias("sources"))
    m = dedupe(matches).agg(F.count("*").alias("matches"))
    return c.join(m, how="cross").join(explanations.agg(F.count_distinct("reason_code").alias("reason_types"), F.count_distinct("claim_id").alias("claims_explained")), how="cross")


def unused_sources(chunks: DataFrame, matches: DataFrame) -> DataFrame:
    """Sources never retrieved, with the mean utilisation of all."""
    u = source_utilisation(chunks, matches)
    return u.where("retrieval_count = 0").select("source_name").join(F.broadcast(u.agg(F.round(F.avg("utilization_rate"), 4).alias("mean_utilization"))), how="cross")


def claim_graph(matches: DataFrame) -> DataFrame:
    return dedupe(matches).groupBy("claim_id", "reason_code", "source_name").agg(F.count("*").alias("n"))


def evidence(matches: DataFrame) -> DataFrame:
    """Best row of each (claim, reason, source, section or else chunk)."""
    return first_by(matches.withColumn("place", F.coalesce("section_title", F.col("policy_chunk_id").cast("string"))), ["claim_id", "reason_code", "source_name", "place"], F.desc("similarity_score"), "policy_chunk_id")


def score_range(matches: DataFrame) -> DataFrame:
    return matches.groupBy("reason_code").agg(*(F.round(f("similarity_score"), 4).alias(n) for n, f in (("min_score", F.min), ("mean_score", F.avg), ("max_score", F.max))))
