"""Claim intake: validation, features from lookup tables, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MISSING, UNKNOWN, clip, safe_number
from .gold import COST_MATCH, SPECIALTY, encoded
from .ml import DEFAULT_BANDS, levelled

REQUIRED = ("claim_id", "patient_id", "provider_id")
#: Fixed value: the code of a claim whose flags and fields contradict each other.
INCONSISTENT = "INFER_006"
#: Issue texts by code.
MESSAGES = {
    "CLAIM_ERR_INVALID_AMOUNT": "billed_amount must be a finite, non-negative number.",
    "CLAIM_ERR_AMOUNT_REQUIRED": "Billed amount is required.",
    "CLAIM_WARN_AMOUNT_MISSING": "Billed amount is missing. The model can still score the claim using imputation, but review confidence is lower.",
    "CLAIM_WARN_MISSING_DIAGNOSIS": "Diagnosis code is missing. This may weaken medical-necessity support and increase denial risk.",
    "CLAIM_WARN_MISSING_PROCEDURE": "Procedure code is missing. The billed service is incomplete for review.",
    "CLAIM_WARN_PROC_WITHOUT_DIAGNOSIS": "Procedure is present without a supporting diagnosis code.",
    "CLAIM_WARN_DIAGNOSIS_WITHOUT_PROC": "Diagnosis is present without a billed procedure code.",
    "CLAIM_WARN_UNKNOWN_PROVIDER": "Provider ID was not found in training/reference artifacts. Provider-history features will use safe defaults.",
    "CLAIM_WARN_UNKNOWN_DIAGNOSIS": "Diagnosis code was not found in reference artifacts. Severity features will use safe defaults.",
    "CLAIM_WARN_UNKNOWN_PROCEDURE": "Procedure code was not found in cost benchmark artifacts. Cost features may use safe defaults.",
    "CLAIM_INFO_INPUT_NORMALIZED": "Claim input passed blocking validation and was normalized for inference.",
}


def given(c: str) -> Column:
    """Trimmed text; empty, nan and null are null."""
    t = F.trim(F.col(c).cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def issue(code: str, field: str | None, severity: str, when: Column, message: str | None = None) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), F.lit(message or MESSAGES[code]).alias("message"), F.lit(severity).alias("severity"), F.lit(severity == "ERROR").alias("blocking")))


def _some(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda x: x.isNotNull())


def validate(claims: DataFrame, lookups: dict[str, DataFrame], require_amount: bool = False) -> DataFrame:
    """Normalised fields, is_valid, and arrays of blocking errors, warnings and infos.

    Membership in the reference sets is a left join on their keys each; an empty set warns of nothing (asked once a set).
    """
    ids = {c: given(c) for c in REQUIRED}
    codes = {c: F.upper(given(c)) for c in ("diagnosis_code", "procedure_code")}
    raw, amount = given("billed_amount"), safe_number(given("billed_amount"))
    finite = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf")) & (amount >= 0)
    df = claims.withColumns(ids | codes | {"_bad_amount": raw.isNotNull() & ~F.coalesce(finite, F.lit(False)), "billed_amount": F.when(finite, amount)})
    known = {"provider_id": lookups["provider_history"].select("provider_id"), "diagnosis_code": lookups["diagnosis"].select("diagnosis_code"), "procedure_code": lookups["procedure_cost"].select("procedure_code")}
    unknown = {}
    for c, ref in known.items():
        marked = ref.where(F.col(c).isNotNull()).distinct().withColumn(f"_known_{c}", F.lit(True))
        df = df.join(marked, c, "left").join(F.broadcast(marked.agg((F.count("*") > 0).alias(f"_any_{c}"))), how="cross")
        unknown[c] = F.col(c).isNotNull() & F.col(f"_any_{c}") & F.col(f"_known_{c}").isNull()
    d, p, a = (F.col(c).isNotNull() for c in ("diagnosis_code", "procedure_code", "billed_amount"))
    no_amount = ~a & ~F.col("_bad_amount")
    errors = _some(*(issue("CLAIM_ERR_REQUIRED_FIELD_MISSING", c, "ERROR", F.col(c).isNull(), f"{c} is required.") for c in REQUIRED), issue("CLAIM_ERR_INVALID_AMOUNT", "billed_amount", "ERROR", F.col("_bad_amount")), issue("CLAIM_ERR_AMOUNT_REQUIRED", "billed_amount", "ERROR", no_amount & F.lit(require_amount)))
    warnings = _some(
        issue("CLAIM_WARN_AMOUNT_MISSING", "billed_amount", "WARNING", no_amount & F.lit(not require_amount)), issue("CLAIM_WARN_MISSING_DIAGNOSIS", "diagnosis_code", "WARNING", ~d), issue("CLAIM_WARN_MISSING_PROCEDURE", "procedure_code", "WARNING", ~p),
        issue("CLAIM_WARN_PROC_WITHOUT_DIAGNOSIS", "diagnosis_code", "WARNING", p & ~d), issue("CLAIM_WARN_DIAGNOSIS_WITHOUT_PROC", "procedure_code", "WARNING", d & ~p),
        issue("CLAIM_WARN_UNKNOWN_PROVIDER", "provider_id", "WARNING", unknown["provider_id"]), issue("CLAIM_WARN_UNKNOWN_DIAGNOSIS", "diagnosis_code", "WARNING", unknown["diagnosis_code"]), issue("CLAIM_WARN_UNKNOWN_PROCEDURE", "procedure_code", "WARNING", unknown["procedure_code"]),
    )
    out = df.withColumns({"blocking_errors": errors, "warnings": warnings}).withColumn("is_valid", F.size("blocking_errors") == 0)
    return out.withColumn("infos", _some(issue("CLAIM_INFO_INPUT_NORMALIZED", None, "INFO", F.col("is_valid")))).drop("_bad_amount", *(f"_{k}_{c}" for k in ("known", "any") for c in known))


def contradictions(claims: DataFrame) -> DataFrame:
    """Adds contradiction: the first field whose missing flag is set although it has a value. Claims without such flags have none."""
    has = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", MISSING)
    present = {"billed_amount": F.col("billed_amount").isNotNull(), "diagnosis_code": has("diagnosis_code"), "procedure_code": has("procedure_code")}
    found = [F.when(F.col(f"{c}_missing") & here, c) for c, here in present.items() if f"{c}_missing" in claims.columns]
    return claims.withColumn("contradiction", F.coalesce(*found, F.lit(None).cast("string")))


def build_features(claims: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """Model features of new claims from lookup tables; unknown keys get safe defaults. The deviation is capped unrounded."""
    df = claims.withColumns({c: F.coalesce(F.upper(given(c)), F.lit(MISSING)) for c in ("diagnosis_code", "procedure_code")}).withColumn("billed_amount", F.when(safe_number(F.col("billed_amount")) >= 0, safe_number(F.col("billed_amount"))))
    df = df.drop("specialty", "location").join(lookups["provider_history"].select("provider_id", "provider_claim_count", "provider_violation_rate", "specialty", "location"), "provider_id", "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(UNKNOWN)) for c in ("specialty", "location")}).join(lookups["patient_counts"], "patient_id", "left")
    df = df.join(lookups["diagnosis"].select("diagnosis_code", "severity_rank"), "diagnosis_code", "left").join(lookups["amount_medians"], "procedure_code", "left")
    df = df.join(lookups["regional_cost"].select("procedure_code", F.col("region").alias("location"), F.col("expected_cost").alias("near")), ["procedure_code", "location"], "left")
    df = df.join(lookups["procedure_cost"].select("procedure_code", F.col("expected_cost").alias("far")), "procedure_code", "left").join(F.broadcast(lookups["scalars"]), how="cross")
    d, p = F.col("diagnosis_code") == MISSING, F.col("procedure_code") == MISSING
    amount, cost = F.coalesce("billed_amount", "procedure_median", "global_median"), F.coalesce("near", "far")
    deviation = F.when(cost > 0, (amount - cost) / cost * 100)
    df = df.withColumns({
        "diagnosis_code_missing": d, "procedure_code_missing": p, "billed_amount_missing": F.col("billed_amount").isNull(), "proc_no_diag": d & ~p, "diag_no_proc": p & ~d,
        "amount_imputation_strategy": F.when(F.col("billed_amount").isNotNull(), "original").when(F.col("procedure_median").isNotNull(), "procedure_median").otherwise("global_median"),
        "billed_amount_imputed": amount, "log_billed_amount_imputed": F.log1p(F.greatest(amount, F.lit(0.0))), "cost_match_level": F.when(F.col("near").isNotNull(), "regional").when(F.col("far").isNotNull(), "procedure_avg").otherwise("missing"),
        "billed_deviation_imputed_pct": F.bround(deviation, 4), "billed_deviation_imputed_capped": clip(deviation, -100.0, 500.0), "is_high_cost": F.coalesce(((F.col("expected_cost_p75") > 0) & (amount > F.col("expected_cost_p75"))).cast("int"), F.lit(0)),
        "provider_claim_count": F.coalesce("provider_claim_count", F.lit(0)), "provider_violation_rate": F.coalesce("provider_violation_rate", F.lit(0.0)), "patient_claim_count": F.coalesce("patient_claim_count", F.lit(0)), "severity_rank": F.coalesce("severity_rank", F.lit(0)),
    })
    return df.withColumns({"specialty_encoded": encoded("specialty", SPECIALTY), "cost_match_encoded": encoded("cost_match_level", COST_MATCH)}).drop("near", "far", "procedure_median", "global_median", "expected_cost_p75")


def rule_score(features: DataFrame) -> DataFrame:
    """A fixed score of built features, for use where no model has been fitted: weighted flags and the capped deviation."""
    flag = lambda c: F.col(c).cast("int")
    s = 0.25 * flag("diagnosis_code_missing") + 0.2 * flag("procedure_code_missing") + 0.15 * flag("billed_amount_missing") + 0.2 * F.col("is_high_cost") + 0.2 * F.least(F.greatest(F.coalesce("billed_deviation_imputed_capped", F.lit(0.0)), F.lit(0.0)), F.lit(200.0)) / 200
    return features.withColumn("p", F.round(s, 6))


def score(claims: DataFrame, lookups: dict[str, DataFrame], scorer=rule_score, bands: tuple[float, float] = DEFAULT_BANDS) -> DataFrame:
    """status success or error, with score columns or the first error: a row for every claim. Features are built for claims that
    are valid and don't contradict themselves; `scorer` adds column p to them (ml.scorer(model) for a fitted one)."""
    checked = validate(contradictions(claims), lookups)
    invalid = F.coalesce(F.get("blocking_errors", F.lit(0))["code"], F.when(F.col("contradiction").isNotNull(), INCONSISTENT))
    checked = checked.withColumn("first_error", invalid)
    good = checked.where("first_error is null").drop("is_valid", "blocking_errors", "warnings", "infos", "contradiction", "first_error")
    done = levelled(scorer(build_features(good, lookups)), "p", bands)
    ok = done.select("claim_id", F.lit("success").alias("status"), "risk_score", "risk_level", "predicted_denial", F.lit(None).cast("string").alias("error_code"))
    bad = checked.where("first_error is not null").select("claim_id", F.lit("error").alias("status"), F.lit(None).cast("double").alias("risk_score"), F.lit(None).cast("string").alias("risk_level"), F.lit(None).cast("int").alias("predicted_denial"), F.col("first_error").alias("error_code"))
    return ok.unionByName(bad)


#: Columns that only analysts may see.
ANALYST_ONLY = ("risk_score", "predicted_denial", "error_code")


def for_role(results: DataFrame, role: str) -> DataFrame:
    return results if role == "analyst" else results.drop(*ANALYST_ONLY)
