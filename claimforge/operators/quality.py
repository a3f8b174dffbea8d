"""Soft schema checks and table contracts: report, never drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Checks by table; (column, check, argument). A column in OPTIONAL may be absent.
BRONZE = {
    "claims": [("claim_id", "not_null", None), ("patient_id", "not_null", None), ("provider_id", "not_null", None), ("billed_amount", "not_negative", None), ("denial_flag", "one_of", (0, 1))],
    "providers": [("provider_id", "not_null", None), ("doctor_name", "not_null", None), ("specialty", "not_null", None)],
    "diagnosis": [("diagnosis_code", "not_null", None), ("category", "not_null", None), ("severity", "one_of", ("High", "Medium", "Low"))],
    "cost": [("procedure_code", "not_null", None), ("average_cost", "not_negative", None), ("expected_cost", "not_negative", None), ("region", "not_null", None)],
}
SILVER = {
    "claims": [*((c, "not_null", None) for c in ("claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "diagnosis_code_missing", "procedure_code_missing", "billed_amount_missing", "proc_no_diag", "diag_no_proc")), ("billed_amount", "not_negative", None), ("denial_flag", "one_of", (0, 1))],
    "providers": [(c, "not_null", None) for c in ("provider_id", "doctor_name", "specialty", "location", "location_missing")],
    "diagnosis": [("diagnosis_code", "not_null", None), ("category", "not_null", None), ("severity", "one_of", ("High", "Medium", "Low"))],
    "cost": [("procedure_code", "not_null", None), ("average_cost", "not_negative", None), ("expected_cost", "not_negative", None)],
}
OPTIONAL = {"denial_flag"}
#: Contracted column types; a type with ! is never null (integers fill with 0, booleans with false).
CONTRACTS = {
    "claims_silver": {
        "claim_id": "string", "patient_id": "string", "provider_id": "string", "diagnosis_code": "string", "procedure_code": "string", "billed_amount": "double", "denial_flag": "tinyint",
        "diagnosis_code_missing": "boolean!", "procedure_code_missing": "boolean!", "billed_amount_missing": "boolean!", "proc_no_diag": "boolean!", "diag_no_proc": "boolean!",
    },
    "providers_silver": {"provider_id": "string", "doctor_name": "string", "specialty": "string", "location": "string", "location_missing": "boolean!"},
    "diagnosis_silver": {"diagnosis_code": "string", "category": "string", "severity": "string"},
    "cost_silver": {"procedure_code": "string", "average_cost": "double", "expected_cost": "double", "region": "string", "cost_ratio": "float"},
    "gold_claim_base": {
        "claim_id": "string", "patient_id": "string", "provider_id": "string", "diagnosis_code": "string", "procedure_code": "string", "billed_amount": "double", "denial_flag": "tinyint", "denial_risk_score": "float",
        "diagnosis_code_missing": "boolean!", "procedure_code_missing": "boolean!", "billed_amount_missing": "boolean!", "proc_no_diag": "boolean!", "diag_no_proc": "boolean!",
        "specialty": "string", "location": "string", "category": "string", "severity": "string", "expected_cost": "double", "average_cost": "double", "cost_ratio": "float",
        "billed_deviation_pct": "float", "cost_match_level": "string", "label_source": "string",
    },
    "gold_claim_features": {
        "claim_id": "string", "patient_id": "string", "provider_id": "string", "diagnosis_code": "string", "procedure_code": "string", "billed_amount": "double", "denial_flag": "tinyint", "denial_risk_score": "float",
        "diagnosis_code_missing": "boolean!", "procedure_code_missing": "boolean!", "billed_amount_missing": "boolean!", "proc_no_diag": "boolean!", "diag_no_proc": "boolean!",
        "provider_claim_count": "int!", "provider_avg_billed": "float", "provider_violation_rate": "float", "patient_claim_count": "int!", "severity_encoded": "tinyint!", "severity_rank": "tinyint!", "specialty_encoded": "tinyint!",
        "billed_amount_imputed": "float", "log_billed_amount_imputed": "float", "log_billed_amount": "float", "billed_deviation_capped": "float", "billed_deviation_imputed_pct": "float", "billed_deviation_imputed_capped": "float",
        "is_high_cost": "boolean!", "cost_match_encoded": "tinyint!", "amount_imputation_strategy": "string", "cost_match_level": "string", "label_source": "string",
    },
    "gold_claim_explanations": {
        "claim_id": "string", "risk_score": "float", "risk_level": "string", "predicted_denial": "tinyint", "classification_threshold": "float", "review_threshold": "float", "reason_rank": "tinyint",
        "reason_code": "string", "reason_title": "string", "reason_text": "string", "business_category": "string", "evidence_type": "string", "feature_name": "string", "feature_label": "string", "feature_value": "string",
        "shap_value": "float", "shap_direction": "string", "shap_output_unit": "string", "fix_suggestion": "string", "policy_query": "string", "policy_tags": "string", "model_used": "string", "explanation_version": "string", "created_at": "string",
    },
    "gold_claim_explanation_summary": {
        "claim_id": "string", "risk_score": "float", "risk_level": "string", "predicted_denial": "tinyint", "classification_threshold": "float", "review_threshold": "float", "reason_1": "string", "reason_2": "string", "reason_3": "string",
        "reason_codes": "string", "reason_texts_json": "string", "fix_suggestions_json": "string", "policy_queries_json": "string", "policy_tags_json": "string", "model_used": "string", "explanation_version": "string", "created_at": "string",
    },
    "policy_chunks": {
        "chunk_id": "string", "document_id": "string", "source_name": "string", "source_type": "string", "source_path": "string", "section_title": "string", "page_number": "int", "chunk_index": "int!",
        "chunk_text": "string", "policy_tags_json": "string", "token_estimate": "int!", "embedding_model": "string", "rag_version": "string", "created_at": "string",
    },
    "gold_claim_policy_matches": {
        "claim_id": "string", "risk_score": "float", "risk_level": "string", "predicted_denial": "tinyint", "reason_rank": "tinyint", "reason_code": "string", "reason_title": "string", "reason_text": "string", "fix_suggestion": "string",
        "policy_rank": "tinyint", "policy_chunk_id": "string", "policy_text": "string", "policy_summary": "string", "source_name": "string", "source_type": "string", "source_path": "string", "section_title": "string", "page_number": "int",
        "similarity_score": "float", "raw_similarity_score": "float", "tag_overlap_count": "smallint", "retrieval_query": "string", "query_policy_tags_json": "string", "retrieved_policy_tags_json": "string", "rag_version": "string", "created_at": "string",
    },
    "gold_claim_final_explanations": {
        "claim_id": "string", "risk_score": "float", "risk_level": "string", "predicted_denial": "tinyint", "final_explanation_text": "string", "reasons_json": "string", "policies_json": "string",
        "recommended_actions_json": "string", "rag_version": "string", "created_at": "string",
    },
}


def failed(column: str, check: str, argument) -> Column:
    c = F.col(column)
    if check == "not_null":
        return c.isNull()
    if check == "not_negative":
        return F.coalesce(c.cast("double") < 0, F.lit(False))
    return c.isNotNull() & ~c.isin(*argument)


def validate(df: DataFrame, checks: list[tuple]) -> DataFrame:
    """column, check, failures, status: one aggregate over the table; an absent column fails its checks as `missing`."""
    present = [(c, k, a) for c, k, a in checks if c in df.columns]
    absent = sorted({c for c, _, _ in checks} - set(df.columns) - OPTIONAL)
    one = df.agg(*(F.count_if(failed(c, k, a)).alias(f"_{i}") for i, (c, k, a) in enumerate(present)))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.col(f"_{i}").alias("failures")) for i, (c, k, _) in enumerate(present)]
    rows += [F.struct(F.lit(c).alias("column"), F.lit("missing").alias("check"), F.lit(1).cast("long").alias("failures")) for c in absent]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.column", "x.check", "x.failures", F.when(F.col("x.failures") > 0, "warnings").otherwise("passed").alias("status"))


def failure_cases(df: DataFrame, checks: list[tuple], key: str) -> DataFrame:
    """key, column, check, value: a row for each failing value."""
    cases = F.array(*(F.when(failed(c, k, a), F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.col(c).cast("string").alias("value"))) for c, k, a in checks if c in df.columns))
    return df.select(F.col(key), F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("x")).select(key, "x.column", "x.check", "x.value")


def enforce(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Contracted columns cast (what can't be cast is null, or filled where null isn't allowed); others as they are."""
    def shaped(c: str) -> Column:
        kind = contract.get(c)
        if kind is None:
            return F.col(c)
        out = F.col(c).try_cast(kind.rstrip("!"))
        return (F.coalesce(out, F.lit(False if kind.startswith("boolean") else 0).cast(kind[:-1])) if kind.endswith("!") else out).alias(c)

    return df.select(*map(shaped, df.columns))


def contract_issues(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """column, expected, actual: contracted columns of another type; columns that the table lacks are its owner's affair."""
    types = dict(df.dtypes)
    rows = [(c, k.rstrip("!"), types[c]) for c, k in contract.items() if c in types and types[c] != k.rstrip("!")]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
