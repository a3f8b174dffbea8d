"""Business reasons of scored claims, from flags and contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import catalogs

MAX_REASONS = 3
#: What explanation tables say of themselves, and the unit of contributions.
VERSION, UNIT = "week5_xai_v2", "raw_log_odds_contribution"


def label_of(feature: Column) -> Column:
    """A feature's name for readers."""
    names = F.create_map(*(F.lit(x) for pair in catalogs.FEATURE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, feature), feature)


def direction_of(contribution: Column) -> Column:
    return F.when(contribution > 0, "increases_risk").when(contribution < 0, "decreases_risk").otherwise("neutral")


def made_at(created_at: str | None) -> Column:
    """The given time, or now, as ISO text."""
    return F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def top_contributions(contribution: DataFrame, n: int = 10) -> DataFrame:
    """claim_id, rank, feature, value, contribution, label, direction: positive ones by size, then negative ones; none that are 0."""
    w = Window.partitionBy("claim_id").orderBy(F.col("contribution") <= 0, F.desc(F.abs("contribution")), "feature")
    out = contribution.where("contribution <> 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.select("claim_id", "rank", "feature", "value", "contribution", label_of(F.col("feature")).alias("label"), direction_of(F.col("contribution")).alias("direction"))


def critical_rows(features: DataFrame) -> DataFrame:
    """claim_id, reason_code, feature, value, ordinal: a row for each set flag that is a mandatory reason, in catalog order."""
    order = [f for r in catalogs.REASONS if r[8] for f in r[5]]
    codes = {f: r[0] for r in catalogs.REASONS for f in r[5]}
    each = F.array(*(F.when(F.col(f).cast("boolean"), F.struct(F.lit(codes[f]).alias("reason_code"), F.lit(f).alias("feature"), F.lit(1.0).alias("value"), F.lit(i).alias("ordinal"))) for i, f in enumerate(order)))
    return features.select("claim_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("claim_id", "x.*")


def by_feature(spark) -> DataFrame:
    return catalogs.reasons(spark).select(F.explode("source_features").alias("feature"), "reason_code")


def select_reasons(features: DataFrame, top: DataFrame, levels: DataFrame, most: int = MAX_REASONS) -> DataFrame:
    """claim_id, reason_rank, reason_code, feature_name, value, contribution, evidence_type.

    Mandatory reasons first, then mapped contributions (only positive ones for HIGH and MEDIUM claims), each reason once;
    claims without any get their mapped contributions as a fallback.
    """
    code = F.create_map(*(F.lit(x) for r in catalogs.REASONS for f in r[5] for x in (f, r[0])))
    row = lambda place, reason, feature, value, contribution, kind: F.struct(place.alias("place"), reason.alias("reason_code"), feature.alias("feature"), value.alias("value"), contribution.alias("contribution"), F.lit(kind).alias("evidence_type"))
    # a claim's contributions in order of rank, then everything within its row
    tops = top.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "value", "contribution"))).alias("t"))
    flags = {f: r[0] for r in catalogs.REASONS if r[8] for f in r[5]}
    claims = features.select("claim_id", *(F.col(f).cast("boolean").alias(f) for f in flags)).join(levels.select("claim_id", "risk_level"), "claim_id", "left").join(tops, "claim_id", "left").withColumn("t", F.coalesce("t", F.array()))
    of = lambda f: F.coalesce(F.get(F.filter("t", lambda x: x["feature"] == f), F.lit(0))["contribution"], F.lit(0.0))
    must = F.array(*(F.when(F.col(f), row(F.lit(i), F.lit(reason), F.lit(f), F.lit(1.0), of(f), "critical_rule")) for i, (f, reason) in enumerate(flags.items())))
    known = F.filter("t", lambda x: F.try_element_at(code, x["feature"]).isNotNull() & F.col("risk_level").isNotNull())
    mapped = lambda kind, after: F.transform(F.col("known"), lambda x: row(x["rank"] + after, F.try_element_at(code, x["feature"]), x["feature"], x["value"], x["contribution"], kind))
    allowed = F.filter(mapped("shap", 100), lambda x: (x["contribution"] > 0) | ~F.col("risk_level").isin("HIGH", "MEDIUM"))
    found = claims.withColumn("known", known).withColumn("found", F.concat(F.filter(must, lambda x: x.isNotNull()), allowed))
    either = found.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(mapped("fallback", 200)))
    once = F.filter("found", lambda x, i: ~F.exists(F.slice("found", 1, i), lambda y: y["reason_code"] == x["reason_code"]))
    out = either.select("claim_id", F.posexplode(F.slice(once, 1, most)).alias("i", "x"))
    return out.select("claim_id", (F.col("i") + 1).alias("reason_rank"), "x.reason_code", F.col("x.feature").alias("feature_name"), "x.value", "x.contribution", "x.evidence_type")


def reason_text(feature: Column, value: Column, default: Column) -> Column:
    """Wording by feature and value."""
    percent = F.format_string("%.1f", F.bround(F.abs(value), 1))
    out = F.when((feature == "billed_deviation_imputed_capped") & (value > 0), F.concat(F.lit("The billed amount is about "), percent, F.lit("% above the expected benchmark for this procedure.")))
    out = out.when((feature == "billed_deviation_imputed_capped") & (value < 0), F.concat(F.lit("The billed amount is about "), percent, F.lit("% below the expected benchmark; verify the benchmark and amount.")))
    #: Texts for set flags.
    for f, text in {
        "billed_amount_missing": "The source claim did not include a billed amount; the model had to use median imputation.",
        "diagnosis_code_missing": "The source claim is missing a diagnosis code, which weakens medical-necessity support.",
        "procedure_code_missing": "The source claim is missing a procedure code, so the billed service is incomplete.",
        "proc_no_diag": "A procedure is present but no supporting diagnosis is available, which weakens medical-necessity support.",
        "diag_no_proc": "A diagnosis is present but no billed procedure is available, so the claim line is incomplete.",
    }.items():
        out = out.when((feature == f) & (value > 0), text)
    out = out.when((feature == "provider_violation_rate") & value.isNotNull(), F.concat(F.lit("The provider's historical claim-quality risk score is "), F.format_string("%.2f", F.bround(value, 2)), F.lit(", which increased the model risk.")))
    out = out.when((feature == "cost_match_encoded") & (value <= 1), "The cost benchmark is not a strong regional match, so billing review confidence is lower.")
    out = out.when((feature == "severity_rank") & (value >= 2), "The diagnosis has medium/high severity and may require stronger supporting documentation.")
    return out.otherwise(default)


def explanations(reasons: DataFrame, scores: DataFrame, bands: tuple[float, float] = (0.40, 0.65), model: str = "linear", created_at: str | None = None) -> DataFrame:
    """The long table: one row a claim and reason, with texts, fixes and policy queries from the catalog, the bands and model that the scores came
    from, and when it was made. policy_tags is a JSON list, feature_value text."""
    catalog = catalogs.reasons(reasons.sparkSession).drop("source_features", "critical", "ordinal")
    # texts come last: what meets by claim are codes
    out = reasons.join(scores.select("claim_id", "risk_score", "risk_level", "predicted_denial"), "claim_id").join(F.broadcast(catalog), "reason_code")
    return out.select(
        "claim_id",
        "risk_score",
        "risk_level",
        "predicted_denial",
        F.lit(bands[1]).alias("classification_threshold"),
        F.lit(bands[0]).alias("review_threshold"),
        "reason_rank",
        "reason_code",
        "reason_title",
        reason_text(F.col("feature_name"), F.col("value"), F.col("reason_text")).alias("reason_text"),
        "business_category",
        "evidence_type",
        "feature_name",
        label_of(F.col("feature_name")).alias("feature_label"),
        F.col("value").cast("string").alias("feature_value"),
        F.bround("contribution", 6).alias("shap_value"),
        direction_of(F.col("contribution")).alias("shap_direction"),
        F.lit(UNIT).alias("shap_output_unit"),
        "fix_suggestion",
        "policy_query",
        F.to_json("policy_tags").alias("policy_tags"),
        F.lit(model).alias("model_used"),
        F.lit(VERSION).alias("explanation_version"),
        made_at(created_at).alias("created_at"),
    )


def summary(long: DataFrame) -> DataFrame:
    """One row a claim: texts of reasons 1 to 3, ordered lists as JSON, ordered distinct tags. At most MAX_REASONS rows of a claim are gathered."""
    same = ("risk_score", "risk_level", "predicted_denial", "classification_threshold", "review_threshold", "model_used", "explanation_version", "created_at")
    rows = F.array_sort(F.collect_list(F.struct("reason_rank", "reason_code", "reason_text", "fix_suggestion", "policy_query", F.from_json("policy_tags", "array<string>").alias("tags"))))
    out = long.groupBy("claim_id").agg(F.min_by(F.struct(*same), "reason_rank").alias("one"), rows.alias("r"))
    listed = lambda f: F.to_json(F.transform("r", lambda x: x[f]))
    return out.select(
        "claim_id",
        *(f"one.{c}" for c in same[:5]),
        *(F.get("r", F.lit(i))["reason_text"].alias(f"reason_{i + 1}") for i in range(3)),
        listed("reason_code").alias("reason_codes"),
        listed("reason_text").alias("reason_texts_json"),
        listed("fix_suggestion").alias("fix_suggestions_json"),
        listed("policy_query").alias("policy_queries_json"),
        F.to_json(F.array_distinct(F.flatten(F.transform("r", lambda x: x["tags"])))).alias("policy_tags_json"),
        *(f"one.{c}" for c in same[5:]),
    )


def report(long: DataFrame, top: int = 20) -> DataFrame:
    """kind, name, n: claims by level, the most frequent reasons, claims explained."""
    level = long.groupBy(F.col("risk_level").alias("name")).agg(F.count_distinct("claim_id").alias("n")).select(F.lit("level").alias("kind"), "name", "n")
    reason = long.groupBy(F.col("reason_code").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top).select(F.lit("reason").alias("kind"), "name", "n")
    return level.unionByName(reason).unionByName(long.agg(F.count_distinct("claim_id").alias("n")).select(F.lit("claims").alias("kind"), F.lit("explained").alias("name"), "n"))


def unmapped(top: DataFrame) -> DataFrame:
    """feature, n: contributions that no reason stands for."""
    return top.join(F.broadcast(by_feature(top.sparkSession)), "feature", "left_anti").groupBy("feature").agg(F.count("*").alias("n"))


def select_claims(features: DataFrame, ids: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Claims of an id table, or the first n by id."""
    out = features if ids is None else features.join(ids.select("claim_id").distinct(), "claim_id", "left_semi")
    return out if first is None else out.orderBy("claim_id").limit(first)


def picker_order(scores: DataFrame) -> DataFrame:
    """claim_id, risk_level, risk_score, level_rank, sorted by level, score and id (a range-partitioned sort)."""
    level = F.when(F.col("risk_level") == "HIGH", 0).when(F.col("risk_level") == "MEDIUM", 1).otherwise(2)
    return scores.select("claim_id", "risk_level", "risk_score", level.alias("level_rank")).orderBy("level_rank", F.desc("risk_score"), "claim_id")

