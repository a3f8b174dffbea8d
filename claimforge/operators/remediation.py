"""Recommendations and decisions for batches of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import catalogs

#: Fallback reasons by feature, in order, and texts of decisions and defaults.
FALLBACK = [("diagnosis_code_missing", "MISSING_DIAGNOSIS"), ("procedure_code_missing", "MISSING_PROCEDURE"), ("proc_no_diag", "PROCEDURE_WITHOUT_DIAGNOSIS"), ("is_high_cost", "HIGH_COST_CLAIM")]
PROCEED = "Proceed with normal submission after standard claim checks."
ROUTE = "Route this claim for analyst review before submission."
WHY_PROCEED = "The model classified the claim as low risk and no blocking validation errors were found."
WHY_ROUTE = "The model classified the claim as needing additional review."
WHY_FIX = "The claim cannot be safely processed until this input issue is fixed."
WHY_REASON = "The model identified this as a relevant risk factor."
BLOCKED_SUMMARY = "Claim cannot be scored/submitted until blocking input errors are corrected."
HIGH_SUMMARY = "High denial risk. Analyst review and remediation are required before submission."
MEDIUM_SUMMARY = "Moderate denial risk. Review recommended before submission."
URGENT_SUMMARY = "Low model risk, but validation/recommendation warnings deserve review."
READY_SUMMARY = "No blocking issues were found and model risk is low."
RISKY = ("HIGH", "MEDIUM")


def recommendations(checked: DataFrame, scores: DataFrame, reasons: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, place, action, priority, why, reason_code, evidence_source: blocking fixes, reason actions, warning actions, a default;
    each action of a claim once, its first.

    Blocked claims count as unscored: they have fixes and warnings only. Claims of low risk get no reason actions.
    checked: claim_id, blocking_errors, warnings; scores: claim_id, risk_level; reasons: claim_id, reason_rank, reason_code,
    fix_suggestion, reason_text; evidence: claim_id, reason_code, source_name, policy_rank.
    """
    act = F.create_map(*(x for code, action, why in catalogs.ACTIONS for x in (F.lit(code), F.struct(F.lit(action).alias("action"), F.lit(why).alias("why")))))
    none = F.lit(None).cast("string")
    columns = ("place", "action", "priority", "why", "reason_code", "evidence_source")

    def row(place, action, priority, why, reason_code, source=none):
        return F.struct(*(c.alias(n) for n, c in zip(columns, (place, action, priority, why, reason_code, source), strict=True)))

    # all that is said of a claim meets in its row, so its actions are found there
    source = evidence.groupBy("claim_id", "reason_code").agg(F.min(F.struct("policy_rank", "source_name"))["source_name"].alias("source"))
    given = reasons.select("claim_id", "reason_rank", "reason_code", "fix_suggestion", "reason_text").join(source, ["claim_id", "reason_code"], "left")
    given = given.groupBy("claim_id").agg(F.collect_list(F.struct("reason_rank", "reason_code", "fix_suggestion", "reason_text", "source")).alias("given"))
    level = scores.select("claim_id", F.coalesce("risk_level", F.lit("LOW")).alias("level"))
    claims = checked.select("claim_id", "blocking_errors", "warnings").join(level, "claim_id", "left").join(given, "claim_id", "left")
    claims = claims.withColumn("risk_level", F.when(F.size("blocking_errors") == 0, F.col("level")))
    risky = F.coalesce(F.col("risk_level").isin(*RISKY), F.lit(False))
    fix = lambda e: F.concat(F.lit("Fix required input field before scoring: "), F.coalesce(e["field"], F.lit("claim input")), F.lit("."))
    fixes = F.transform("blocking_errors", lambda e, i: row(i, fix(e), F.lit("HIGH"), F.coalesce(e["message"], F.lit(WHY_FIX)), e["code"]))

    def because(x):
        known = F.try_element_at(act, x["reason_code"])
        return row(100 + x["reason_rank"], F.coalesce(known["action"], x["fix_suggestion"], F.lit("Review this claim before submission.")), F.col("risk_level"), F.coalesce(known["why"], x["reason_text"], F.lit(WHY_REASON)), x["reason_code"], x["source"])

    def warned(e, i):
        known = F.try_element_at(act, e["code"])
        return F.when(known.isNotNull(), row(200 + i, known["action"], F.when(risky, "MEDIUM").otherwise("LOW"), known["why"], e["code"]))

    empty = F.array().cast("array<struct<place:int,action:string,priority:string,why:string,reason_code:string,evidence_source:string>>")
    low = F.col("risk_level") == "LOW"
    rest = F.when(F.col("risk_level").isNotNull(), F.array(row(F.lit(300), F.when(low, PROCEED).otherwise(ROUTE), F.col("risk_level"), F.when(low, WHY_PROCEED).otherwise(WHY_ROUTE), none)))
    parts = (fixes, F.when(risky, F.transform("given", because)), F.filter(F.transform("warnings", warned), lambda x: x.isNotNull()), rest)
    every = claims.select("claim_id", F.explode(F.concat(*(F.coalesce(p, empty) for p in parts))).alias("x")).select("claim_id", "x.*")
    # the default is for claims without another action, rows of one id being one claim
    w = Window.partitionBy("claim_id")
    first = every.withColumns({"_least": F.min("place").over(w), "_n": F.row_number().over(Window.partitionBy("claim_id", "action").orderBy("place"))})
    return first.where("_n = 1 and (place < 300 or _least = 300)").drop("_n", "_least")


def decisions(checked: DataFrame, scores: DataFrame, recs: DataFrame) -> DataFrame:
    """claim_id, status, priority, summary."""
    r = recs.groupBy("claim_id").agg(F.bool_or(F.col("priority").isin(*RISKY)).alias("urgent"))
    df = checked.select("claim_id", (F.size("blocking_errors") > 0).alias("blocked")).join(scores.select("claim_id", "risk_level"), "claim_id", "left").join(r, "claim_id", "left")
    level, urgent = F.coalesce("risk_level", F.lit("LOW")), F.coalesce("urgent", F.lit(False))
    verdict = lambda status, priority, text: F.struct(F.lit(status).alias("status"), F.lit(priority).alias("priority"), F.lit(text).alias("summary"))
    found = (
        F.when(F.col("blocked"), verdict("BLOCKED", "HIGH", BLOCKED_SUMMARY)).when(level == "HIGH", verdict("REVIEW_REQUIRED", "HIGH", HIGH_SUMMARY))
        .when(level == "MEDIUM", verdict("REVIEW_RECOMMENDED", "MEDIUM", MEDIUM_SUMMARY)).when(urgent, verdict("REVIEW_RECOMMENDED", "MEDIUM", URGENT_SUMMARY))
        .otherwise(verdict("READY_TO_SUBMIT", "LOW", READY_SUMMARY))
    )
    return df.select("claim_id", found.alias("d")).select("claim_id", "d.*")


def analysis(checked: DataFrame, scores: DataFrame, reasons: DataFrame, recs: DataFrame) -> DataFrame:
    """claim_id, status (blocked or success), risk_level and reason codes (none for blocked claims, no codes for low risk), decision, priority, number of recommendations."""
    blocked = F.size("blocking_errors") > 0
    codes = reasons.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("reason_rank", "reason_code"))).alias("r"))
    n = recs.groupBy("claim_id").agg(F.count("*").alias("n"))
    df = checked.select("claim_id", blocked.alias("blocked")).join(scores.select("claim_id", "risk_level"), "claim_id", "left").join(codes, "claim_id", "left").join(n, "claim_id", "left").join(decisions(checked, scores, recs), "claim_id")
    risky = ~F.col("blocked") & F.col("risk_level").isin(*RISKY)
    listed = F.array_join(F.transform("r", lambda x: x["reason_code"]), ",")
    return df.select("claim_id", F.when(F.col("blocked"), "blocked").otherwise("success").alias("status"), F.when(~F.col("blocked"), F.col("risk_level")).alias("risk_level"), F.coalesce(F.when(risky, listed), F.lit("")).alias("reason_codes"), F.col("status").alias("decision"), "priority", F.coalesce("n", F.lit(0)).alias("recommendations"))


def fallback_reasons(features: DataFrame, levels: DataFrame, most: int = 3) -> DataFrame:
    """claim_id, reason_rank, reason_code of risky claims by set flags; one general reason where no flag is set; none for LOW."""
    risky = features.join(levels.where(F.col("risk_level").isin("HIGH", "MEDIUM")).select("claim_id"), "claim_id", "left_semi")
    each = F.filter(F.array(*(F.when(F.col(f).cast("boolean"), F.lit(code)) for f, code in FALLBACK)), lambda x: x.isNotNull())
    picked = F.when(F.size(each) > 0, F.slice(each, 1, most)).otherwise(F.array(F.lit("MODEL_REVIEW_RISK")))
    return risky.select("claim_id", F.posexplode(picked).alias("i", "reason_code")).select("claim_id", (F.col("i") + 1).alias("reason_rank"), "reason_code")


def presentation(checked: DataFrame, scores: DataFrame, reasons: DataFrame, evidence: DataFrame, recs: DataFrame, most_actions: int = 5, most: int = 3) -> DataFrame:
    """claim_id, summary, action_plan (its first actions), analyst_notes (its first reasons, then its first pieces of evidence).

    scores: claim_id, risk_level, risk_score; reasons as for recommendations(), with reason_title; evidence with reason_rank or not: in order of
    (reason_code, policy_rank), with policy_summary. Blocked and low-risk claims have no reasons, so no notes.
    """
    ordered = lambda key, value, n: F.slice(F.transform(F.array_sort(F.collect_list(F.struct(*key, value))), lambda x: x["v"]), 1, n)
    plan = recs.groupBy("claim_id").agg(ordered(["place"], F.col("action").alias("v"), most_actions).alias("action_plan"))
    risky = scores.where(F.col("risk_level").isin(*RISKY)).select("claim_id").join(checked.where(F.size("blocking_errors") == 0).select("claim_id"), "claim_id", "left_semi")
    said = reasons.join(risky, "claim_id", "left_semi").groupBy("claim_id").agg(ordered(["reason_rank"], F.concat("reason_title", F.lit(": "), "reason_text").alias("v"), most).alias("said"))
    shown = evidence.join(risky, "claim_id", "left_semi").where("policy_summary <> ''").groupBy("claim_id").agg(ordered(["reason_code", "policy_rank"], F.concat(F.lit("Policy evidence from "), "source_name", F.lit(": "), "policy_summary").alias("v"), most).alias("shown"))
    df = decisions(checked, scores, recs).join(scores.select("claim_id", "risk_level", "risk_score"), "claim_id", "left")
    for part in (plan, said, shown):
        df = df.join(part, "claim_id", "left")
    blocked = F.format_string("Claim %s is blocked because required input validation failed. Correct the blocking fields before scoring or submission.", "claim_id")
    scored = F.format_string("Claim %s is %s risk with a score of %.1f%%. %s", "claim_id", F.coalesce("risk_level", F.lit("UNKNOWN")), F.bround(F.coalesce("risk_score", F.lit(0.0)) * 100, 1), "summary")
    none = F.array().cast("array<string>")
    return df.select("claim_id", F.when(F.col("status") == "BLOCKED", blocked).otherwise(scored).alias("summary"), F.coalesce("action_plan", none).alias("action_plan"), F.concat(F.coalesce("said", none), F.coalesce("shown", none)).alias("analyst_notes"))
