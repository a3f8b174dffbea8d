"""Fixed catalogs as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Business reasons in catalog order.
#: (code, title, category, text, fix, source features, policy query, policy tags, critical)
REASONS = [
    ("MISSING_DIAGNOSIS", "Missing diagnosis code", "claim_completeness", "The claim is missing a diagnosis code, so the payer may not be able to verify medical necessity.", "Add a valid diagnosis code that supports the billed procedure.", ["diagnosis_code_missing"], "Diagnosis code is required on a healthcare claim to support medical necessity and payer adjudication.", ["diagnosis", "medical_necessity", "claim_completeness"], True),
    ("MISSING_PROCEDURE", "Missing procedure code", "claim_completeness", "The claim is missing a procedure code, so the payer may not know what service was billed.", "Add the correct procedure/CPT code before submission.", ["procedure_code_missing"], "Procedure code is required to identify the service billed on a claim.", ["procedure", "coding", "claim_completeness"], True),
    ("MISSING_AMOUNT", "Missing billed amount", "claim_completeness", "The billed amount is missing, which makes payment adjudication incomplete.", "Enter the billed amount and verify it against the expected cost benchmark.", ["billed_amount_missing"], "Billed amount charge information is required for payer claim adjudication.", ["billing", "amount", "claim_completeness"], True),
    ("PROCEDURE_WITHOUT_DIAGNOSIS", "Procedure without diagnosis support", "medical_necessity", "A procedure is present but the diagnosis is missing, so medical necessity is not supported.", "Link the billed procedure to a valid supporting diagnosis code.", ["proc_no_diag"], "Procedure must be supported by a diagnosis code or clinical indication to establish medical necessity.", ["diagnosis", "procedure", "medical_necessity"], True),
    ("DIAGNOSIS_WITHOUT_PROCEDURE", "Diagnosis without billed procedure", "claim_completeness", "A diagnosis is present but the procedure is missing, so the billed service is incomplete.", "Add the procedure code for the performed service or remove unsupported diagnosis-only billing.", ["diag_no_proc"], "Claim line requires procedure/service information when billing for a diagnosis-related encounter.", ["diagnosis", "procedure", "claim_completeness"], True),
    ("HIGH_BILLING_AMOUNT", "Billed amount above expected benchmark", "billing_review", "The billed amount is materially higher than the expected benchmark for this procedure.", "Verify the billed amount, check modifiers/units, and attach supporting documentation if justified.", ["billed_deviation_imputed_capped", "billed_amount_imputed", "log_billed_amount_imputed", "is_high_cost"], "Claims with charges above expected or usual cost benchmarks may require documentation, justification, or additional review.", ["billing", "high_cost", "documentation"], False),
    ("WEAK_COST_BENCHMARK", "Weak or missing cost benchmark", "billing_review", "The system could not find a strong regional cost benchmark for this procedure.", "Review the procedure cost manually or add/update regional benchmark data.", ["cost_match_encoded"], "Cost benchmark or fee schedule review for billed procedure and region.", ["billing", "benchmark", "fee_schedule"], False),
    ("PROVIDER_HISTORY_RISK", "Provider history indicates higher claim-quality risk", "provider_history", "This provider has a higher historical rate of incomplete or structurally risky claims.", "Review the provider submission checklist before sending the claim.", ["provider_violation_rate"], "Provider claims with repeated missing documentation or incomplete claim fields require review.", ["provider", "documentation", "quality_review"], False),
    ("PROVIDER_VOLUME_RISK", "Provider has high claim volume", "provider_history", "The provider has a high volume of claims, which can increase duplicate or batch-submission review risk.", "Check for duplicate submissions and validate claim batch quality.", ["provider_claim_count"], "High-volume provider claim submissions should be checked for duplicate or incomplete billing.", ["provider", "duplicate_claim", "batch_review"], False),
    ("PATIENT_FREQUENCY_RISK", "Patient has frequent claims", "utilization_review", "This patient has multiple claims in the dataset, so duplicate or utilization review may be needed.", "Verify this is not a duplicate claim and ensure medical documentation supports the service.", ["patient_claim_count"], "Frequent patient claims may require duplicate claim review or utilization review.", ["patient", "duplicate_claim", "utilization_review"], False),
    ("HIGH_SEVERITY_SUPPORT", "Diagnosis severity needs supporting documentation", "documentation", "The diagnosis severity may require stronger supporting documentation for the billed service.", "Attach relevant clinical notes and supporting documentation.", ["severity_rank", "severity_encoded"], "Severe diagnoses and high-risk services require supporting clinical documentation.", ["severity", "documentation", "medical_necessity"], False),
    ("SPECIALTY_REVIEW", "Provider specialty should match billed service", "provider_credentials", "The provider specialty may need to be checked against the billed service.", "Verify provider specialty and credentials match the procedure being billed.", ["specialty_encoded"], "Provider specialty or credentials must be appropriate for the billed procedure.", ["provider", "specialty", "credentialing"], False),
]
#: Names of features for readers; a feature without one is shown by its column name.
FEATURE_LABELS = {
    "diagnosis_code_missing": "Missing Diagnosis Code",
    "procedure_code_missing": "Missing Procedure Code",
    "billed_amount_missing": "Missing Billed Amount",
    "proc_no_diag": "Procedure Without Diagnosis",
    "diag_no_proc": "Diagnosis Without Procedure",
    "billed_deviation_imputed_capped": "Billing Deviation From Expected",
    "billed_amount_imputed": "Median-Imputed Billed Amount",
    "log_billed_amount_imputed": "Billed Amount (log scale, imputed)",
    "is_high_cost": "High-Cost Claim",
    "cost_match_encoded": "Cost Benchmark Match Quality",
    "provider_claim_count": "Provider Activity Volume",
    "provider_violation_rate": "Provider Historical Violation Rate",
    "patient_claim_count": "Patient Claim Frequency",
    "severity_rank": "Diagnosis Severity",
    "specialty_encoded": "Provider Specialty",
    "billed_deviation_capped": "Billing Deviation From Expected",
    "log_billed_amount": "Billed Amount (log scale)",
    "severity_encoded": "Diagnosis Severity",
}
#: Actions by reason code, and by warning code.
ACTIONS = [
    ("MISSING_DIAGNOSIS", "Add or verify the ICD diagnosis code before submission.", "The claim lacks diagnosis support needed to justify the billed service."),
    ("MISSING_PROCEDURE", "Add the billed procedure code before submission.", "The claim is incomplete without a procedure/service code."),
    ("PROCEDURE_WITHOUT_DIAGNOSIS", "Link the procedure to a supporting diagnosis code.", "A billed procedure generally needs medical-necessity support."),
    ("DIAGNOSIS_WITHOUT_PROCEDURE", "Add the performed procedure or remove unsupported diagnosis-only claim data.", "A diagnosis-only claim line is incomplete for billing review."),
    ("HIGH_BILLING_AMOUNT", "Review the billed amount against the expected benchmark and attach justification if appropriate.", "The billed amount is materially above expected cost benchmarks."),
    ("HIGH_COST_CLAIM", "Check prior authorization and documentation requirements for the high-cost claim.", "High-cost claims often require additional documentation or authorization."),
    ("WEAK_COST_BENCHMARK", "Verify procedure, provider location, and cost benchmark before submission.", "The available cost benchmark is not a strong match for the claim context."),
    ("PROVIDER_VOLUME_RISK", "Route this claim for manual review because provider activity volume is elevated.", "High-volume provider patterns can indicate duplicate, batch, or incomplete submissions."),
    ("PROVIDER_HISTORY_RISK", "Use the claim-quality checklist before submission because provider history indicates elevated risk.", "Provider history has contributed to higher claim-quality risk."),
    ("PATIENT_FREQUENCY_RISK", "Review for duplicate, repeated, or unusually frequent claims for this patient.", "High patient claim frequency can increase payer review risk."),
    ("DIAGNOSIS_SEVERITY_SUPPORT", "Ensure clinical documentation supports the diagnosis severity.", "Medium/high severity diagnoses may need stronger supporting records."),
    ("SPECIALTY_CREDENTIAL_CHECK", "Verify that the provider specialty and credentials align with the billed service.", "Specialty mismatch can increase denial or manual-review risk."),
    ("CLAIM_WARN_MISSING_DIAGNOSIS", "Add a diagnosis code if available before submitting the claim.", "Missing diagnosis is a non-blocking warning but can increase denial risk."),
    ("CLAIM_WARN_MISSING_PROCEDURE", "Add a procedure code if the billed service is known.", "Missing procedure is a non-blocking warning but makes the claim incomplete."),
    ("CLAIM_WARN_AMOUNT_MISSING", "Verify and enter billed amount when available.", "The model can impute amount, but real amount improves review quality."),
    ("CLAIM_WARN_UNKNOWN_PROVIDER", "Confirm the provider ID and add/update provider reference data if needed.", "Unknown provider IDs use safe defaults and reduce provider-history confidence."),
    ("CLAIM_WARN_UNKNOWN_DIAGNOSIS", "Confirm the diagnosis code and update diagnosis reference data if needed.", "Unknown diagnosis codes use safe defaults and reduce severity-confidence."),
    ("CLAIM_WARN_UNKNOWN_PROCEDURE", "Confirm the procedure code and update cost benchmark data if needed.", "Unknown procedure codes reduce cost-benchmark confidence."),
]
#: Error codes the library's jobs can raise (code, category, severity, retryable, message).
ERRORS = [
    ("INGEST_001", "file_io", "ERROR", True, "A required raw CSV file is missing. Place it in data/raw and rerun ingestion."),
    ("INGEST_002", "schema_validation", "WARNING", False, "Raw data did not fully match the expected schema. Bronze preserved the data for Silver review."),
    ("INGEST_003", "schema_validation", "ERROR", False, "Schema validation failed unexpectedly during ingestion."),
    ("INGEST_004", "file_io", "ERROR", True, "The Bronze Parquet file could not be written."),
    ("INGEST_005", "configuration", "ERROR", False, "The requested dataset is not registered in the ingestion registry."),
    ("INGEST_999", "unknown", "ERROR", False, "An unexpected error occurred. Check logs for details."),
    ("SILVER_001", "file_io", "ERROR", True, "A Bronze input file is missing. Run ingestion before Silver cleaning."),
    ("SILVER_002", "schema_validation", "WARNING", False, "Silver data did not fully match schema expectations. Review the validation report."),
    ("SILVER_003", "schema_validation", "ERROR", False, "Silver validation failed unexpectedly."),
    ("SILVER_004", "data_quality", "WARNING", False, "One or more negative billed amounts were converted to null."),
    ("SILVER_005", "data_quality", "WARNING", False, "Duplicate IDs were detected and only the first record was kept."),
    ("SILVER_006", "file_io", "ERROR", True, "The Silver Parquet file could not be written."),
    ("SILVER_999", "unknown", "ERROR", False, "An unexpected error occurred. Check logs for details."),
    ("GOLD_001", "file_io", "ERROR", True, "A Silver input file is missing. Run Silver cleaning before Gold feature engineering."),
    ("GOLD_002", "data_quality", "ERROR", False, "No usable denial_flag was found and synthetic-label fallback was unavailable."),
    ("GOLD_003", "data_quality", "CRITICAL", False, "Gold feature engineering changed the claim row count. Check joins for duplication or row loss."),
    ("GOLD_004", "data_quality", "CRITICAL", False, "The cost join created duplicate claim rows. Use regional match plus procedure-level fallback."),
    ("GOLD_005", "data_quality", "ERROR", False, "An expected ML feature was not produced by the Gold pipeline."),
    ("GOLD_006", "file_io", "ERROR", True, "A Gold artifact could not be written."),
    ("GOLD_999", "unknown", "ERROR", False, "An unexpected error occurred. Check logs for details."),
    ("ML_001", "file_io", "ERROR", True, "The Gold feature table is missing. Run Gold before training."),
    ("ML_002", "data_quality", "ERROR", False, "The model target column denial_flag is missing or invalid."),
    ("ML_003", "model_training", "ERROR", False, "The dataset could not be split for training. Check row count and class balance."),
    ("ML_004", "model_training", "ERROR", False, "Model training failed. Review feature data and dependency versions."),
    ("ML_005", "model_training", "ERROR", False, "Risk-threshold tuning failed. Check validation predictions and labels."),
    ("ML_006", "model_training", "WARNING", False, "Calibration report generation failed. Probability quality is unknown."),
    ("ML_007", "file_io", "ERROR", True, "A model artifact could not be saved."),
    ("ML_999", "unknown", "ERROR", False, "An unexpected error occurred. Check logs for details."),
    ("INFER_001", "file_io", "ERROR", True, "No trained model was found. Run training before inference."),
    ("INFER_002", "file_io", "ERROR", True, "Feature lookup artifacts are missing. Run Gold before inference."),
    ("INFER_003", "data_quality", "ERROR", False, "The custom claim input is invalid. Correct the fields and retry."),
    ("INFER_004", "model_inference", "ERROR", False, "The claim could not be converted into model features."),
    ("INFER_005", "model_inference", "ERROR", False, "The model failed to produce a prediction."),
    ("INFER_006", "data_quality", "WARNING", False, "The custom claim contains contradictory fields."),
    ("INFER_999", "unknown", "ERROR", False, "An unexpected error occurred. Check logs for details."),
    ("XAI_001", "file_io", "ERROR", True, "Gold claim features are missing. Run run_gold.py before run_explain.py."),
    ("XAI_002", "explainability", "ERROR", True, "The XGBoost model required for SHAP explanations is missing. Run run_train.py."),
    ("XAI_003", "explainability", "ERROR", False, "Prediction and explanation models do not match. Use XGBoost for Week 5 explanations."),
    ("XAI_004", "explainability", "ERROR", False, "A SHAP feature could not be mapped to a business reason."),
    ("XAI_005", "explainability", "ERROR", False, "The system failed to generate an explanation for a claim."),
    ("XAI_006", "explainability", "WARNING", False, "Some claims failed during explanation generation. Review failed_claims in the report."),
    ("XAI_007", "file_io", "ERROR", True, "The explanation output table could not be written."),
    ("XAI_008", "explainability", "WARNING", False, "No mapped business reason was generated for the claim."),
    ("XAI_009", "explainability", "ERROR", False, "The raw claim could not be converted into features for explanation."),
    ("XAI_999", "unknown", "ERROR", False, "An unexpected error occurred. Check logs for details."),
    ("RAG_001", "rag", "ERROR", True, "A policy document is missing from the RAG corpus."),
    ("RAG_002", "rag", "ERROR", False, "A policy document could not be parsed."),
    ("RAG_003", "rag", "ERROR", True, "The embedding model could not be loaded."),
    ("RAG_004", "rag", "ERROR", False, "Text embeddings could not be generated."),
    ("RAG_005", "rag", "ERROR", True, "The vector index is missing. Run policy ingestion before retrieval."),
    ("RAG_006", "rag", "ERROR", False, "Policy retrieval failed for a reason query."),
    ("RAG_007", "rag", "WARNING", False, "No relevant policy chunk met the retrieval threshold."),
    ("RAG_999", "unknown", "ERROR", False, "An unexpected error occurred. Check logs for details."),
    ("CONFIG_001", "configuration", "ERROR", False, "Configuration is invalid or incomplete."),
    ("OBS_001", "observability", "WARNING", True, "The error tracker failed to persist an event, but execution continued."),
    ("SYSTEM_999", "unknown", "ERROR", False, "An unexpected error occurred. Check logs for details."),
]
#: Policy tags and the words that stand for them, in order.
TAGS = [
    ("diagnosis", ["diagnosis", "diagnostic", "icd", "icd-10"]),
    ("medical_necessity", ["medical necessity", "medically necessary", "clinical support", "clinical justification"]),
    ("claim_completeness", ["required field", "complete claim", "incomplete", "missing", "must include"]),
    ("procedure_coding", ["procedure", "cpt", "hcpcs", "code combination", "coding edit", "coding"]),
    ("documentation", ["documentation", "supporting document", "records", "attachment", "evidence"]),
    ("prior_authorization", ["prior authorization", "pre-authorization", "preauthorization", "pre-claim"]),
    ("high_cost", ["high cost", "above expected", "cost benchmark", "unusual charge", "excessive"]),
    ("provider", ["provider", "billing provider", "rendering provider", "credential"]),
    ("duplicate", ["duplicate", "resubmission", "same service"]),
    ("payer_policy", ["payer", "insurer", "coverage", "payment policy"]),
]


def reasons(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(REASONS)]
    return spark.createDataFrame(rows, "ordinal int, reason_code string, reason_title string, business_category string, reason_text string, fix_suggestion string, source_features array<string>, policy_query string, policy_tags array<string>, critical boolean")


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTIONS, "code string, action string, why string")


def errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "error_code string, category string, severity string, retryable boolean, user_message string")
