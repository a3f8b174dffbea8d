"""Registered queries over models, intake, reasons, retrieval, remediation, events, sources and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Claims, shared_folder
from ..functions.text import ellipsis, html_to_text, tag_list
from ..operators import catalogs
from ..operators import events as E
from ..operators import intake as I
from ..operators import ml as M
from ..operators import reasons as X
from ..operators import remediation as D
from ..operators import retrieval as R
from ..operators import retrieval_analytics as V
from ..operators import silver as S
from ..operators.dense import dense_search
from ..operators.terms import terms
from ..sources import io
from ..streaming import streams
from .claims import ORACLE, QUERIES, lookups, query

__all__ = ["ORACLE", "QUERIES"]


def folder(t: Claims, name: str) -> str:
    return shared_folder(t.spark, name)


# --- models: metrics on a given score ---
AUC = "(select sum(pos * (under + neg / 2.0)) / (sum(pos) * sum(neg))::double from (select pos, neg, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as under from (select score, sum(label) as pos, sum(1 - label) as neg from scored group by score)))"
METRICS = f"""select tp as true_positives, fp as false_positives, fn as false_negatives, tn as true_negatives, total, round_even(tp * 1.0::double / (tp + fn), 4) as recall, round_even(tp * 1.0::double / (tp + fp), 4) as precision, round_even(tp * 2.0::double / (2 * tp + fp + fn), 4) as f1,
 round_even((tp + tn) * 1.0::double / total, 4) as accuracy, round_even({AUC}, 4) as roc_auc, 0.5::double as threshold from (select count(*) filter (score >= 0.5 and label = 1) as tp, count(*) filter (score >= 0.5 and label = 0) as fp, count(*) filter (score < 0.5 and label = 1) as fn, count(*) filter (score < 0.5 and label = 0) as tn, count(*) as total from scored)"""
query("m5_metrics", METRICS)(lambda t: M.metrics(t.scored))
# a second score that orders rows almost as the first does, but is lower
SECOND = "select row_id, label, round(score * score, 3) as score from scored"
query(
    "m5_comparison",
    f"""select *, row_number() over (order by roc_auc desc, recall desc, model desc) = 1 as selected from (
 select *, 'trees' as model from ({METRICS}) union all select *, 'linear' as model from (with second as ({SECOND}) {METRICS.replace("from scored", "from second")}))""",
)(lambda t: M.compare(t.scored.withColumn("second", F.round(F.col("score") * F.col("score"), 3)), {"trees": "score", "linear": "second"}))
SWEEP = """select round(i * 0.005::double + 0.05::double, 3) as threshold, cast(sum(case when score >= round(i * 0.005::double + 0.05::double, 3) and label = 1 then c else 0 end) as bigint) as tp, cast(sum(case when score >= round(i * 0.005::double + 0.05::double, 3) and label = 0 then c else 0 end) as bigint) as fp,
 cast(sum(case when label = 1 then c else 0 end) as bigint) as pos, cast(sum(c) as bigint) as n from (select score, label, count(*) as c from scored group by all), (select unnest(range(181)) as i) group by i"""
query("m6_sweep", f"select threshold, tp, fp, pos - tp as fn, n - pos - fp as tn, round(case when pos > 0 then tp * 1.0::double / pos else 0 end, 6) as recall, round(case when tp + fp > 0 then tp * 1.0::double / (tp + fp) else 0 end, 6) as precision from ({SWEEP})")(lambda t: M.sweep(t.scored).select("threshold", "tp", "fp", "fn", "tn", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision")))
CHOICE = f"""select threshold, recall, precision, f1, f2 from (select threshold, tp * 1.0::double / pos as recall, case when tp + fp > 0 then tp * 1.0::double / (tp + fp) else 0 end as precision, tp * 2.0::double / (tp + fp + pos) as f1, tp * 5.0::double / (4 * pos + tp + fp) as f2 from ({SWEEP}))
 order by case when recall >= 0.9 then 0 else 1 end, case when recall >= 0.9 then f1 else f2 end desc, case when recall >= 0.9 then precision else recall end desc, case when recall >= 0.9 then threshold else precision end desc, threshold limit 1"""
query("m6_threshold", f"select threshold, round_even(recall, 4) as recall, round_even(precision, 4) as precision, round_even(f1, 4) as f1, round_even(f2, 4) as f2, round_even(least(greatest(threshold * 0.7, 0.2), 0.4), 4) as medium_from from ({CHOICE})")(lambda t: M.choose_threshold(t.scored))
query("m8_calibration", """select cast(b.bin as int) as bin, coalesce(n, 0) as count, round(p, 4) as avg_prob, round(r, 4) as actual_rate, round(p - r, 4) as gap, round(w.brier, 4) as brier, round(w.ece, 4) as ece from (select unnest(range(10)) as bin) b
 left join (select least(9, cast(floor(round(score * 10, 6)) as int)) as bin, count(*) as n, avg(score) as p, avg(label) as r from scored group by 1) f using (bin),
 (select sum(sq) / sum(n) as brier, sum(n * abs(p - r)) / sum(n) as ece from (select least(9, cast(floor(round(score * 10, 6)) as int)) as bin, count(*) as n, avg(score) as p, avg(label) as r, sum((score - label) * (score - label)) as sq from scored group by 1)) w""")(lambda t: M.calibration(t.scored))
query("m11_roc", """select score, round(sum(pos) over (order by score desc) * 1.0::double / sum(pos) over (), 6) as tpr, round(sum(neg) over (order by score desc) * 1.0::double / sum(neg) over (), 6) as fpr from (select score, sum(label) as pos, sum(1 - label) as neg from scored group by score)""")(lambda t: M.roc_points(t.scored))
query("m12_confusion", f"select label, (score >= (select threshold from ({CHOICE})))::int as predicted, count(*) as n from scored group by all")(lambda t: M.confusion(t.scored))
query("m13_score_histogram", "select label, least(29, cast(floor(round(score * 30, 6)) as int)) as bin, count(*) as n from scored group by all")(lambda t: M.score_histogram(t.scored))
query("m14_levels", "select row_id, round_even(score, 4) as risk_score, case when score >= 0.65 then 'HIGH' when score >= 0.4 then 'MEDIUM' else 'LOW' end as risk_level, (score >= 0.65)::int as predicted_denial from scored")(lambda t: M.levelled(t.scored, "score").select("row_id", "risk_score", "risk_level", "predicted_denial"))
DESIGN = "claim_id, denial_flag, diagnosis_code_missing::int::double as diagnosis_code_missing, procedure_code_missing::int::double as procedure_code_missing, is_high_cost::double as is_high_cost, cost_match_encoded::double as cost_match_encoded, severity_rank::double as severity_rank"
DESIGN_COLUMNS = ("diagnosis_code_missing", "procedure_code_missing", "is_high_cost", "cost_match_encoded", "severity_rank")
query("m1_design_matrix", f"select {DESIGN} from features")(lambda t: M.design_matrix(t.features, DESIGN_COLUMNS))
query("m2_split", "select case when u < 6 then 'train' when u < 8 then 'validation' else 'test' end as part, denial_flag, count(*) as n from (select denial_flag, ('0x' || substr(md5(claim_id || '42'), 1, 8))::bigint % 10 as u from features) group by all")(lambda t: M.split(M.design_matrix(t.features)).groupBy("part", "denial_flag").agg(F.count("*").alias("n")))


def parts(t: Claims) -> DataFrame:
    return t.layer("model_parts", lambda: M.split(M.design_matrix(t.features)))


def scored_by(t: Claims, kind: str, rounds: int = 10) -> DataFrame:
    data = parts(t)
    return M.predict(M.fit(data, kind, rounds), data.where("part = 'test'")).select("claim_id", "denial_flag", "risk_score", "risk_level", "predicted_denial")


def explained_by(t: Claims) -> DataFrame:
    data = parts(t)
    return M.fitted_contributions(M.fit(data), data.where("part = 'test'"))


query("m3_logistic")(lambda t: scored_by(t, "logistic"))
query("m4_boosted_trees")(lambda t: scored_by(t, "trees", rounds=200))
query("x1_fitted")(explained_by)
query("m10_fitted")(lambda t: M.importance(explained_by(t).where("feature <> 'base value'")))

# --- intake ---

WARNINGS = {
    "CLAIM_WARN_AMOUNT_MISSING": "billed_amount is null",
    "CLAIM_WARN_MISSING_DIAGNOSIS": "diagnosis_code is null",
    "CLAIM_WARN_MISSING_PROCEDURE": "procedure_code is null",
    "CLAIM_WARN_PROC_WITHOUT_DIAGNOSIS": "procedure_code is not null and diagnosis_code is null",
    "CLAIM_WARN_DIAGNOSIS_WITHOUT_PROC": "diagnosis_code is not null and procedure_code is null",
    "CLAIM_WARN_UNKNOWN_PROVIDER": "provider_id not in (select provider_id from claims)",
    "CLAIM_WARN_UNKNOWN_DIAGNOSIS": "diagnosis_code is not null and upper(trim(diagnosis_code)) not in (select diagnosis_code from diagnosis)",
    "CLAIM_WARN_UNKNOWN_PROCEDURE": "procedure_code is not null and upper(trim(procedure_code)) not in (select procedure_code from by_procedure)",
}
WARNED_OF = ", ".join(f"case when {when} then '{code}' end" for code, when in WARNINGS.items())


@query("i1_validation", f"select claim_id, billed_amount is null or billed_amount >= 0 as is_valid, case when billed_amount < 0 then 'CLAIM_ERR_INVALID_AMOUNT' else '' end as errors, array_to_string([x for x in [{WARNED_OF}] if x is not null], ',') as warnings from claims_raw")
def i1(t: Claims) -> DataFrame:
    codes = lambda c: F.array_join(F.transform(c, lambda x: x["code"]), ",").alias(c.replace("blocking_", ""))
    return I.validate(t.claims_raw, lookups(t)).select("claim_id", "is_valid", codes("blocking_errors"), codes("warnings"))


query("i2_contradictions", "select claim_id, case when billed_amount is not null and denial_flag = 1 then 'billed_amount' end as contradiction from claims")(lambda t: I.contradictions(t.claims.withColumn("billed_amount_missing", F.col("billed_amount_missing") | (F.col("denial_flag") == 1))).select("claim_id", "contradiction"))
query("i3_features", """select claim_id, amount_imputation_strategy, cost_match_level, case when expected_cost > 0 then round(least(greatest((billed_amount_imputed - expected_cost) / expected_cost * 100, -100), 500), 3) end as billed_deviation_imputed_capped, is_high_cost, provider_claim_count, patient_claim_count, severity_rank, specialty_encoded from features""")(
    lambda t: I.build_features(t.claims, lookups(t)).select("claim_id", "amount_imputation_strategy", "cost_match_level", F.round("billed_deviation_imputed_capped", 3).alias("billed_deviation_imputed_capped"), "is_high_cost", "provider_claim_count", "patient_claim_count", "severity_rank", "specialty_encoded"))
query("i4_scoring", "select case when billed_amount is null or billed_amount >= 0 then 'success' else 'error' end as status, case when billed_amount < 0 then 'CLAIM_ERR_INVALID_AMOUNT' end as error_code, count(*) as n from claims_raw group by all")(lambda t: I.score(t.claims_raw, lookups(t)).groupBy("status", "error_code").agg(F.count("*").alias("n")))
query(
    "i4_inconsistent",
    """select status, error_code, count(*) as n from (select case when billed_amount is null or (billed_amount >= 0 and denial_flag = 0) then 'success' else 'error' end as status,
 case when billed_amount < 0 then 'CLAIM_ERR_INVALID_AMOUNT' when billed_amount is not null and denial_flag = 1 then 'INFER_006' end as error_code from claims_raw) group by all""",
)(lambda t: I.score(t.claims_raw.withColumn("billed_amount_missing", F.col("denial_flag") == 1), lookups(t)).groupBy("status", "error_code").agg(F.count("*").alias("n")))
query("i4_fitted")(lambda t: I.score(t.claims_raw, lookups(t), M.scorer(M.fit(parts(t)))))
query("i5_roles", "select claim_id, case when billed_amount is null or billed_amount >= 0 then 'success' else 'error' end as status from claims_raw")(lambda t: I.for_role(I.score(t.claims_raw, lookups(t)), "reviewer").select("claim_id", "status"))

# --- reasons: a linear model with fixed weights ---
WEIGHTS = {"diagnosis_code_missing": 1.2, "procedure_code_missing": 0.9, "is_high_cost": 0.7, "cost_match_encoded": -0.4, "severity_rank": 0.3, "patient_claim_count": 0.02}
MEANS = {"diagnosis_code_missing": 0.15, "procedure_code_missing": 0.1, "is_high_cost": 0.9, "cost_match_encoded": 1.0, "severity_rank": 1.5, "patient_claim_count": 30.0}
CONTRIBUTION = " union all ".join(f"select claim_id, '{c}' as feature, {c}::int::double as value, round_even({w}::double * ({c}::int::double - {MEANS[c]}::double), 4) as contribution from features" for c, w in WEIGHTS.items())
TOPS = f"select claim_id, cast(row_number() over (partition by claim_id order by contribution <= 0, abs(contribution) desc, feature) as int) as rank, feature, value, contribution from ({CONTRIBUTION}) where contribution <> 0"
LEVEL = "select claim_id, case when s >= 0.65 then 'HIGH' when s >= 0.4 then 'MEDIUM' else 'LOW' end as risk_level, round_even(s, 4) as risk_score from (select claim_id, round(0.6::double * diagnosis_code_missing::int + 0.4::double * procedure_code_missing::int + 0.3::double * is_high_cost, 4) as s from features)"


def contributions(t: Claims) -> DataFrame:
    return M.contributions(t.features, WEIGHTS, MEANS)


def tops(t: Claims) -> DataFrame:
    return X.top_contributions(contributions(t))


def levels(t: Claims) -> DataFrame:
    s = F.round(0.6 * F.col("diagnosis_code_missing").cast("int") + 0.4 * F.col("procedure_code_missing").cast("int") + 0.3 * F.col("is_high_cost"), 4)
    return M.levelled(t.features.select("claim_id", s.alias("s")), "s")


def picked(t: Claims) -> DataFrame:
    return t.layer("reasons", lambda: X.select_reasons(t.features, tops(t), levels(t)))


def long(t: Claims) -> DataFrame:
    return t.layer("explanations", lambda: X.explanations(picked(t), levels(t), created_at=MADE))


#: When the tables of these queries say they were made, so that a run can be compared with another.
MADE = "2026-01-01T00:00:00Z"
MAPPED = {f: (i, r[0]) for i, r in enumerate(catalogs.REASONS) for f in r[5]}
CRITICAL = [f for r in catalogs.REASONS if r[8] for f in r[5]]
SHAP_CODE = " ".join(f"when '{f}' then '{c}'" for f, (_, c) in MAPPED.items())
REASON_ROWS = " union all ".join(
    f"select f.claim_id, '{MAPPED[c][1]}' as reason_code, '{c}' as feature, 1.0::double as value, coalesce(t.contribution, 0) as contribution, 'critical_rule' as evidence_type, {i} as place from features f left join (select * from tops where feature = '{c}' and rank <= 10) t using (claim_id) where f.{c}"
    for i, c in enumerate(CRITICAL)
)
PICKED = f"""select claim_id, cast(reason_rank as int) as reason_rank, reason_code, feature as feature_name, value, contribution, evidence_type from (
 select *, row_number() over (partition by claim_id order by place) as reason_rank from (select *, row_number() over (partition by claim_id, reason_code order by place) as k from (
 with tops as ({TOPS}) {REASON_ROWS}
 union all select claim_id, case feature {SHAP_CODE} end as reason_code, feature, value, contribution, 'shap' as evidence_type, rank + 100 as place from tops join ({LEVEL}) using (claim_id) where contribution > 0 or risk_level = 'LOW')) where k = 1) where reason_rank <= 3"""
query("x1_contributions", CONTRIBUTION)(contributions)
query("x2_top_contributions", f"select * from ({TOPS}) where rank <= 10")(lambda t: tops(t).drop("label", "direction"))
query("x3_critical_reasons", " union all ".join(f"select claim_id, '{MAPPED[f][1]}' as reason_code, {i} as ordinal from features where {f}" for i, f in enumerate(CRITICAL)))(lambda t: X.critical_rows(t.features).select("claim_id", "reason_code", "ordinal"))
query("x4_reasons", PICKED)(lambda t: picked(t).select("claim_id", "reason_rank", "reason_code", "feature_name", "value", "contribution", "evidence_type"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CATALOG = ", ".join("(" + ", ".join([quoted(code), quoted(name), quoted(kind), quoted(text), quoted(fix), quoted(asked_), quoted(json.dumps(tags, separators=(",", ":")))]) + ")" for code, name, kind, text, fix, _, asked_, tags, _ in catalogs.REASONS)
SHOWN = " ".join(f"when {quoted(f)} then {quoted(n)}" for f, n in catalogs.FEATURE_LABELS.items())
#: The long table in SQL: texts by feature and value where the operator has them, otherwise the catalog's.
EXPLAINED = f"""select claim_id, l.risk_score, l.risk_level, (l.risk_level = 'HIGH')::int as predicted_denial, 0.65::double as classification_threshold, 0.4::double as review_threshold, reason_rank, reason_code, reason_title,
 case when feature_name = 'billed_amount_missing' and value > 0 then 'The source claim did not include a billed amount; the model had to use median imputation.'
 when feature_name = 'diagnosis_code_missing' and value > 0 then 'The source claim is missing a diagnosis code, which weakens medical-necessity support.'
 when feature_name = 'procedure_code_missing' and value > 0 then 'The source claim is missing a procedure code, so the billed service is incomplete.'
 when feature_name = 'proc_no_diag' and value > 0 then 'A procedure is present but no supporting diagnosis is available, which weakens medical-necessity support.'
 when feature_name = 'diag_no_proc' and value > 0 then 'A diagnosis is present but no billed procedure is available, so the claim line is incomplete.'
 when feature_name = 'cost_match_encoded' and value <= 1 then 'The cost benchmark is not a strong regional match, so billing review confidence is lower.'
 when feature_name = 'severity_rank' and value >= 2 then 'The diagnosis has medium/high severity and may require stronger supporting documentation.' else base_text end as reason_text,
 business_category, evidence_type, feature_name, case feature_name {SHOWN} else feature_name end as feature_label, value::varchar as feature_value, round_even(contribution, 6) as shap_value,
 case when contribution > 0 then 'increases_risk' when contribution < 0 then 'decreases_risk' else 'neutral' end as shap_direction, 'raw_log_odds_contribution' as shap_output_unit, fix_suggestion, policy_query, policy_tags,
 'linear' as model_used, 'week5_xai_v2' as explanation_version, '{MADE}' as created_at
 from ({PICKED}) p join ({LEVEL}) l using (claim_id) join (values {CATALOG}) c(reason_code, reason_title, business_category, base_text, fix_suggestion, policy_query, policy_tags) using (reason_code)"""
SUMMED = f"""select claim_id, any_value(risk_score) as risk_score, any_value(risk_level) as risk_level, any_value(predicted_denial) as predicted_denial, any_value(classification_threshold) as classification_threshold, any_value(review_threshold) as review_threshold,
 max(case when reason_rank = 1 then reason_text end) as reason_1, max(case when reason_rank = 2 then reason_text end) as reason_2, max(case when reason_rank = 3 then reason_text end) as reason_3,
 to_json(list(reason_code order by reason_rank))::varchar as reason_codes, to_json(list(reason_text order by reason_rank))::varchar as reason_texts_json, to_json(list(fix_suggestion order by reason_rank))::varchar as fix_suggestions_json,
 to_json(list(policy_query order by reason_rank))::varchar as policy_queries_json, (with g as (select tag, min(place) as place from (select unnest(tags) as tag, unnest(range(len(tags))) as place from (select flatten(list(policy_tags::json::varchar[] order by reason_rank)) as tags)) group by tag) select to_json(list(tag order by place))::varchar from g) as policy_tags_json,
 'linear' as model_used, 'week5_xai_v2' as explanation_version, '{MADE}' as created_at from ({EXPLAINED}) group by claim_id"""
query("x6_reason_text", f"select claim_id, reason_code, reason_text from ({EXPLAINED})")(lambda t: long(t).select("claim_id", "reason_code", "reason_text"))
query("x7_explanations", EXPLAINED)(long)
query("x8_summary", SUMMED)(lambda t: X.summary(long(t)))
query("x9_report", f"with p as ({PICKED}), l as ({LEVEL}) select 'level' as kind, risk_level as name, count(distinct claim_id) as n from p join l using (claim_id) group by 2 union all select 'reason', reason_code, count(*) from p group by 2 union all select 'claims', 'explained', count(distinct claim_id) from p")(lambda t: X.report(long(t)))
query("x10_unmapped", "select 'provider_avg_billed' as feature, count(*) as n from features where round_even(0.001::double * (provider_avg_billed::double - 30000.0::double), 4) <> 0 having count(*) > 0")(lambda t: X.unmapped(X.top_contributions(M.contributions(t.features, {"severity_rank": 0.3, "provider_avg_billed": 0.001}, {"severity_rank": 1.5, "provider_avg_billed": 30000.0}))))
query("x11_selected_claims", "select claim_id from features where claim_id in (select claim_id from claims where denial_flag = 1) order by claim_id limit 100")(lambda t: X.select_claims(t.features, t.claims.where("denial_flag = 1"), 100).select("claim_id"))
query("x12_picker_order", f"select claim_id, risk_level, risk_score, case risk_level when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end as level_rank from ({LEVEL})")(lambda t: X.picker_order(levels(t)))
query("m10_importance", f"select feature, round(avg(abs(contribution)), 6) as mean_abs_contribution from ({CONTRIBUTION}) group by feature")(lambda t: M.importance(contributions(t)))

# --- corpus and retrieval ---
TEST_TAGS = [("first", ["thble", "thtion"]), ("second", ["thing", "attion"]), ("third", ["ering"]), ("coding", ["code"]), ("billing", ["billed", "billing"])]


#: What each test document asks for at its end, so that reasons find something among invented words.
SENTENCES = [r[6] for r in catalogs.REASONS]


def policy_docs(t: Claims) -> DataFrame:
    """Documents as policies: a heading, the text and a sentence of the reasons' catalog."""
    asks = F.get(F.array(*map(F.lit, SENTENCES)), (F.col("doc_id") % len(SENTENCES)).cast("int"))
    return t.table("documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("source_name"), F.lit("text").alias("source_type"), F.concat(F.lit("documents/"), "source").alias("source_path"),
        F.concat(F.lit("# Section "), (F.col("doc_id") % 5).cast("string"), F.lit("\n"), F.col("text"), F.lit("\n"), asks).alias("text"),
    )


def corpus(t: Claims) -> DataFrame:
    return t.layer("policy_chunks", lambda: R.chunks(policy_docs(t), tags=TEST_TAGS, created_at=MADE))


BODY = f"(select doc_id, source, text || chr(10) || [{', '.join(map(quoted, SENTENCES))}][doc_id % {len(SENTENCES)} + 1] as text from documents)"
WORDS = f"[x for x in regexp_split_to_array(text, '{R.BLANK}') if x <> '']"
CHUNKS = f"""select document_id, source_name, section_title, cast(i as int) as window_index, array_to_string(w[i * 350 + 1 : i * 350 + 420], ' ') as chunk_text, len(w[i * 350 + 1 : i * 350 + 420]) as n_words from (select *, unnest(range(cast(greatest(0, ceil((len(w) - 420) / 350.0)) as int) + 1)) as i from (
 select doc_id::varchar as document_id, source as source_name, 'Section ' || (doc_id % 5)::varchar as section_title, {WORDS} as w from {BODY} where trim(text, chr(10) || chr(13) || chr(9) || ' ') <> ''))"""
query("r1_sections", f"select doc_id::varchar as document_id, 'Section ' || (doc_id % 5)::varchar as section_title, 1 as section_index from {BODY} where trim(text, chr(10) || chr(13) || chr(9) || ' ') <> ''")(lambda t: R.sections(policy_docs(t)).select("document_id", "section_title", F.col("section_index").cast("int").alias("section_index")))
query("r2_windows", f"select document_id, window_index, md5(chunk_text) as digest, n_words from ({CHUNKS})")(lambda t: R.windows(R.sections(policy_docs(t))).select("document_id", "window_index", F.md5(F.col("chunk_text").cast("binary")).alias("digest"), "n_words"))
TAGGED = ", ".join(f"case when {' or '.join(f'contains(l, {quoted(w)})' for w in words)} then {quoted(tag)} end" for tag, words in TEST_TAGS)
query("r3_tags", f"select document_id, window_index, array_to_string([x for x in [{TAGGED}] if x is not null], ',') as tags from (select *, lower(section_title || ' ' || chunk_text) as l from ({CHUNKS}))")(
    lambda t: corpus(t).select("document_id", "window_index", F.array_join("policy_tags", ",").alias("tags"))
)
query("r4_chunk_ids", f"select document_id, window_index, substr(sha256(document_id || '|1|' || window_index::varchar || '|' || substr(chunk_text, 1, 160)), 1, 24) as chunk_id, greatest(1, floor(n_words * 1.33))::int as token_estimate from ({CHUNKS})")(lambda t: corpus(t).select("document_id", "window_index", "chunk_id", "token_estimate"))


def term_table(t: Claims) -> DataFrame:
    return t.layer("policy_terms", lambda: terms(corpus(t), "chunk_id", "chunk_text"))


DENSE = """select query_id, vec_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as score from embeddings q, embeddings c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)) where rank <= {k}"""


def dense(t: Claims, k: int) -> DataFrame:
    e = t.table("embeddings")
    return dense_search(e.where("vec_id % 50 = 0"), e, k)


query("r8_dense_search", DENSE.format(k=3))(lambda t: dense(t, 3))


def tagged(t: Claims) -> DataFrame:
    tags = t.table("embeddings").select("vec_id", F.array(F.concat(F.lit("t"), F.col("label").cast("string")), F.concat(F.lit("g"), (F.col("label") % 3).cast("string"))).alias("tags"))
    return dense(t, 12).join(tags.select(F.col("vec_id").alias("query_id"), F.col("tags").alias("query_tags")), "query_id").join(tags.select("vec_id", F.col("tags").alias("chunk_tags")), "vec_id")


RERANK = f"""select query_id, vec_id, round(score, 6) as raw_similarity_score, s as similarity_score, o as tag_overlap_count, cast(policy_rank as int) as policy_rank from (select *, row_number() over (partition by query_id order by s desc, o desc, vec_id) as policy_rank from (
 select h.*, (qe.label = ce.label)::int + (qe.label % 3 = ce.label % 3)::int as o, round(score + 0.04::double * ((qe.label = ce.label)::int + (qe.label % 3 = ce.label % 3)::int), 6) as s from ({DENSE.format(k=12)}) h join embeddings qe on qe.vec_id = h.query_id join embeddings ce on ce.vec_id = h.vec_id) where s >= 0.25) where policy_rank <= 3"""
query("r9_rerank", RERANK)(lambda t: R.rerank(tagged(t), "query_id", "vec_id"))


ASKED = "case when contains(policy_query, reason_text) then policy_query else policy_query || chr(10) || 'Reason: ' || reason_text end"
query("r10_queries", f"select claim_id, reason_code, {ASKED} as retrieval_query from ({EXPLAINED})")(lambda t: long(t).select("claim_id", "reason_code", R.compose_query(F.col("policy_query"), F.col("reason_text")).alias("retrieval_query")))


def searched(t: Claims) -> DataFrame:
    """The match rows over the document chunks, not written."""
    write = lambda df, name: t.layer(f"policy_{name}", lambda: df)
    return R.matches(long(t), corpus(t), term_table(t), min_score=0.0, created_at=MADE, write=write)


def policy_matches(t: Claims) -> DataFrame:
    """The match table over the document chunks."""
    return t.layer("policy_match_table", lambda: searched(t))


def matches(t: Claims) -> DataFrame:
    """Match rows for analytics: every explained (claim, reason) with nearest vectors standing for policy chunks."""
    return t.layer("policy_matches", lambda: _matches(t))


def _matches(t: Claims) -> DataFrame:
    hits = R.rerank(tagged(t), "query_id", "vec_id")
    e = picked(t).select("claim_id", "reason_code").withColumn("query_id", ((F.length("claim_id") * 7 + F.length("reason_code")) % 26 * 50).cast("long"))
    return e.join(hits, "query_id").select("claim_id", "reason_code", F.col("vec_id").alias("policy_chunk_id"), F.concat(F.lit("source"), (F.col("vec_id") % 7).cast("string")).alias("source_name"), F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string"))).alias("section_title"), "similarity_score", "policy_rank")


def chunk_rows(t: Claims) -> DataFrame:
    return t.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("source"), (F.col("vec_id") % 9).cast("string")).alias("source_name"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text"))


query("r13_summaries", "select doc_id, case when length(f) > 420 then rtrim(substr(f, 1, 419)) || '…' else f end as summary from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as f from documents)")(lambda t: t.table("documents").select("doc_id", ellipsis(F.col("text")).alias("summary")))
#: Final explanations show the best policy of each reason, so only that one meets the claims; the match table isn't written for them.
query("r14_final")(lambda t: R.final_explanations(searched(t).where("policy_rank = 1"), MADE))
query("r16_tag_lists", "select doc_id, array_to_string([x for x in [trim(y) for y in string_split(source || ', ' || lang || ',', ',')] if x <> ''], '|') as tags from documents")(lambda t: t.table("documents").select("doc_id", F.array_join(tag_list(F.concat("source", F.lit(", "), "lang", F.lit(","))), "|").alias("tags")))

# --- retrieval analytics ---
MATCHES = f"""select e.claim_id, e.reason_code, h.vec_id as policy_chunk_id, 'source' || (h.vec_id % 7)::varchar as source_name, case when h.vec_id % 2 = 0 then 's' || (h.vec_id % 4)::varchar end as section_title, h.similarity_score
 from ({PICKED}) e join ({RERANK}) h on h.query_id = (length(e.claim_id) * 7 + length(e.reason_code)) % 26 * 50"""
UTILISATION = """select c.source_name, policy_chunks, coalesce(r, 0) as retrieval_count, coalesce(u, 0) as unique_chunks_retrieved, avg_similarity, round(coalesce(u, 0) / policy_chunks::double, 4) as utilization_rate from (select 'source' || (vec_id % 9)::varchar as source_name, count(distinct vec_id) as policy_chunks from embeddings group by 1) c
 left join (select source_name, count(*) as r, count(distinct policy_chunk_id) as u, round(avg(similarity_score), 4) as avg_similarity from m group by 1) using (source_name)"""
_m = lambda sql: f"with m as ({MATCHES}), p as ({PICKED}) {sql}"
query("v1_dedupe", _m("select * from m"))(lambda t: V.dedupe(matches(t)).select(*V.KEYS, "similarity_score"))
query("v2_source_utilisation", _m(UTILISATION))(lambda t: V.source_utilisation(chunk_rows(t), matches(t)))
query("v3_flow", _m("select reason_code as reason, source_name as source, count(*) as n from m group by all order by n desc, reason, source limit 50"))(lambda t: V.reason_source_flow(matches(t)))
query("v3_all_sources", "select distinct 'source' || (vec_id % 9)::varchar as source_name from embeddings")(lambda t: V.all_sources(chunk_rows(t), matches(t)))
query("v4_reason_coverage", _m("""select reason_code, reason_rows, coalesce(matched_rows, 0) as matched_rows, avg_similarity, coalesce(top_policy_source, '—') as top_policy_source, round(coalesce(matched_rows, 0) / reason_rows::double, 4) as match_rate from (select reason_code, count(distinct claim_id) as reason_rows from p group by 1)
 left join (select reason_code, count(distinct claim_id) as matched_rows, round(avg(similarity_score), 4) as avg_similarity from m group by 1) using (reason_code)
 left join (select reason_code, source_name as top_policy_source from (select reason_code, source_name, row_number() over (partition by reason_code order by n desc, source_name) as k from (select reason_code, source_name, count(*) as n from m group by all)) where k = 1) using (reason_code)"""))(lambda t: V.reason_coverage(long(t), matches(t)))
query("v5_top_chunks", _m("select policy_chunk_id, retrieval_count, avg_similarity, 'source' || (policy_chunk_id % 9)::varchar as source_name, 'chunk ' || policy_chunk_id::varchar as snippet from (select policy_chunk_id, count(*) as retrieval_count, round(avg(similarity_score), 4) as avg_similarity from m group by 1 order by 2 desc, 1 limit 20)"))(lambda t: V.top_chunks(chunk_rows(t), matches(t)))
query("v7_strength", _m("select claim_id, reason_code, abs(contribution) as model_strength, best_similarity from p join (select claim_id, reason_code, max(similarity_score) as best_similarity from m group by all) using (claim_id, reason_code)"))(lambda t: V.strength(long(t), matches(t)))
query("r15_report", _m(f"""select 'documents' as metric, count(*) as value from documents union all select 'chunks', count(*) from ({CHUNKS}) union all select 'match_rows', count(*) from m
 union all select 'unmatched_reasons', count(*) from p where not exists (select 1 from m where m.claim_id = p.claim_id and m.reason_code = p.reason_code)"""))(lambda t: R.match_report(policy_docs(t), corpus(t), long(t), matches(t)))
query("v8_similarity_quartiles", _m("select reason_code, round(quantile_cont(similarity_score, 0.25), 4) as q1, round(quantile_cont(similarity_score, 0.5), 4) as median, round(quantile_cont(similarity_score, 0.75), 4) as q3 from m where reason_code in (select reason_code from m group by 1 order by count(*) desc, 1 limit 12) group by 1"))(lambda t: V.similarity_quartiles(matches(t), write=lambda df, name: t.layer(f"policy_{name}", lambda: df)))
query("v8_similarity_histogram", _m("select least(29, greatest(0, cast(floor(round(similarity_score * 30, 6)) as int))) as bin, count(*) as n from m group by 1"))(lambda t: V.similarity_histogram(matches(t)))
query("v9_kpis", _m("select (select count(*) from embeddings) as chunks, (select count(distinct vec_id % 9) from embeddings) as sources, (select count(*) from m) as matches, (select count(distinct reason_code) from p) as reason_types, (select count(distinct claim_id) from p) as claims_explained"))(lambda t: V.kpis(chunk_rows(t), matches(t), long(t)))
query("v10_unused_sources", _m(f"select source_name, mean_utilization from ({UTILISATION}), (select round(avg(utilization_rate), 4) as mean_utilization from ({UTILISATION})) where retrieval_count = 0"))(lambda t: V.unused_sources(chunk_rows(t), matches(t)))
query("v11_claim_graph", _m("select claim_id, reason_code, source_name, count(*) as n from m group by all"))(lambda t: V.claim_graph(matches(t)))
query("v12_evidence", _m("select claim_id, reason_code, source_name, place, policy_chunk_id, similarity_score from (select *, row_number() over (partition by claim_id, reason_code, source_name, place order by similarity_score desc, policy_chunk_id) as k from (select *, coalesce(section_title, policy_chunk_id::varchar) as place from m)) where k = 1"))(lambda t: V.evidence(matches(t)).select("claim_id", "reason_code", "source_name", "place", "policy_chunk_id", "similarity_score"))
query("v13_score_range", _m("select reason_code, round(min(similarity_score), 4) as min_score, round(avg(similarity_score), 4) as mean_score, round(max(similarity_score), 4) as max_score from m group by 1"))(lambda t: V.score_range(matches(t)))
query("d4_evidence", _m("select claim_id, reason_code, policy_chunk_id, similarity_score from m where similarity_score >= 0.2"))(lambda t: V.first_by(matches(t).where("similarity_score >= 0.2"), ["claim_id", "reason_code", "policy_chunk_id"], F.desc("similarity_score")).select("claim_id", "reason_code", "policy_chunk_id", "similarity_score"))
query("r12_unmatched", _m("select claim_id, reason_code from p where not exists (select 1 from m where m.claim_id = p.claim_id and m.reason_code = p.reason_code)"))(lambda t: R.unmatched(long(t), matches(t)))


# --- remediation ---
def checked(t: Claims) -> DataFrame:
    """Deduplicated raw claims, validated: those with a negative amount are blocked."""
    columns = ("claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount")
    return t.layer("validated_claims", lambda: I.validate(S.first_claims(t.claims_raw).select(*columns), lookups(t)))


def evidence(t: Claims) -> DataFrame:
    return matches(t).where("similarity_score >= 0.2").withColumn("policy_summary", F.concat(F.lit("chunk "), F.col("policy_chunk_id").cast("string")))


def recommended(t: Claims) -> DataFrame:
    return t.layer("recommendations", lambda: D.recommendations(checked(t), levels(t), long(t), evidence(t)))


ACTS = ", ".join(f"({quoted(code)}, {quoted(action)}, {quoted(why)})" for code, action, why in catalogs.ACTIONS)
FIXES = ", ".join(f"({quoted(r[0])}, {quoted(r[1])}, {quoted(r[4])})" for r in catalogs.REASONS)
WARNED = {
    "CLAIM_WARN_AMOUNT_MISSING": "billed_amount is null",
    "CLAIM_WARN_MISSING_DIAGNOSIS": "diagnosis_code is null",
    "CLAIM_WARN_MISSING_PROCEDURE": "procedure_code is null",
    "CLAIM_WARN_UNKNOWN_DIAGNOSIS": "diagnosis_code is not null and upper(trim(diagnosis_code)) not in (select diagnosis_code from diagnosis)",
    "CLAIM_WARN_UNKNOWN_PROCEDURE": "procedure_code is not null and upper(trim(procedure_code)) not in (select procedure_code from by_procedure)",
}
#: Texts of the reasons that no action stands for, as the features of a risky claim word them.
WORDED = "case code when 'MISSING_AMOUNT' then 'The source claim did not include a billed amount; the model had to use median imputation.' when 'HIGH_SEVERITY_SUPPORT' then 'The diagnosis has medium/high severity and may require stronger supporting documentation.' end"
ADVICE_CTES = f"""acts(code, action, why) as (values {ACTS}), fixes(code, title, fix) as (values {FIXES}),
 lv as ({LEVEL}), picked as ({PICKED}), verdicts as (select f.claim_id, f.billed_amount < 0 is true as blocked, l.risk_level, l.risk_score from claims_first f left join lv l using (claim_id)),
 warned as ({" union all ".join(f"select claim_id, {i} as i, '{code}' as code from claims_first where {when}" for i, (code, when) in enumerate(WARNED.items()))}),
 given as (select claim_id, 0 as place, 'Fix required input field before scoring: billed_amount.' as action, 'HIGH' as priority, {quoted(I.MESSAGES['CLAIM_ERR_INVALID_AMOUNT'])} as why, 'CLAIM_ERR_INVALID_AMOUNT' as reason_code from verdicts where blocked
  union all select p.claim_id, 100 + reason_rank, coalesce(a.action, x.fix), v.risk_level, coalesce(a.why, {WORDED.replace("case code", "case p.reason_code")}), p.reason_code from picked p join verdicts v using (claim_id) left join acts a on a.code = p.reason_code left join fixes x on x.code = p.reason_code where not v.blocked and v.risk_level <> 'LOW'
  union all select w.claim_id, 200 + i, a.action, case when not v.blocked and v.risk_level <> 'LOW' then 'MEDIUM' else 'LOW' end, a.why, w.code from warned w join verdicts v using (claim_id) join acts a on a.code = w.code),
 advice as (select * from given union all select claim_id, 300, case when risk_level = 'LOW' then {quoted(D.PROCEED)} else {quoted(D.ROUTE)} end, risk_level, case when risk_level = 'LOW' then {quoted(D.WHY_PROCEED)} else {quoted(D.WHY_ROUTE)} end, null from verdicts where not blocked and claim_id not in (select claim_id from given)),
 decided as (select *, case when blocked then 'BLOCKED' when risk_level = 'HIGH' then 'REVIEW_REQUIRED' when risk_level = 'MEDIUM' then 'REVIEW_RECOMMENDED' else 'READY_TO_SUBMIT' end as status, case when blocked or risk_level = 'HIGH' then 'HIGH' when risk_level = 'MEDIUM' then 'MEDIUM' else 'LOW' end as priority,
  case when blocked then {quoted(D.BLOCKED_SUMMARY)} when risk_level = 'HIGH' then {quoted(D.HIGH_SUMMARY)} when risk_level = 'MEDIUM' then {quoted(D.MEDIUM_SUMMARY)} else {quoted(D.READY_SUMMARY)} end as summary from verdicts)"""
query("d1_recommendations", f"with {ADVICE_CTES} select claim_id, action, priority, why, reason_code from advice")(lambda t: recommended(t).select("claim_id", "action", "priority", "why", "reason_code"))
query("d2_decisions", f"with {ADVICE_CTES} select claim_id, status, priority, summary from decided")(lambda t: D.decisions(checked(t), levels(t), recommended(t)))
FALLBACK = " union all ".join(f"select claim_id, {i} as i, '{code}' as reason_code from features where {f}::boolean" for i, (f, code) in enumerate(D.FALLBACK))
query("d3_fallback_reasons", f"""select claim_id, cast(reason_rank as int) as reason_rank, reason_code from (select claim_id, row_number() over (partition by claim_id order by i) as reason_rank, reason_code from ({FALLBACK}) semi join ({LEVEL} ) l using (claim_id) where claim_id in (select claim_id from ({LEVEL}) where risk_level <> 'LOW')) where reason_rank <= 3
 union all select claim_id, 1, 'MODEL_REVIEW_RISK' from ({LEVEL}) where risk_level <> 'LOW' and claim_id not in (select claim_id from ({FALLBACK}))""")(lambda t: D.fallback_reasons(t.features, levels(t)))
query("d5_analysis", f"""with {ADVICE_CTES} select d.claim_id, case when blocked then 'blocked' else 'success' end as status, case when not blocked then risk_level end as risk_level, coalesce(case when not blocked and risk_level <> 'LOW' then codes end, '') as reason_codes, status as decision, priority, n as recommendations
 from decided d left join (select claim_id, string_agg(reason_code, ',' order by reason_rank) as codes from picked group by 1) using (claim_id) left join (select claim_id, count(*) as n from advice group by 1) using (claim_id)""")(lambda t: D.analysis(checked(t), levels(t), long(t), recommended(t)))
query("d6_summaries", f"""with {ADVICE_CTES} select claim_id, case when blocked then 'Claim ' || claim_id || ' is blocked because required input validation failed. Correct the blocking fields before scoring or submission.' else 'Claim ' || claim_id || ' is ' || risk_level || ' risk with a score of ' || printf('%.1f', round_even(risk_score * 100, 1)) || '%. ' || summary end as summary, actions from decided
 left join (select claim_id, string_agg(action, ' | ' order by place) as actions from (select *, row_number() over (partition by claim_id order by place) as k from advice) where k <= 5 group by 1) using (claim_id)""")(lambda t: D.presentation(checked(t), levels(t), long(t), evidence(t), recommended(t)).select("claim_id", "summary", F.array_join("action_plan", " | ").alias("actions")))


# --- events and streams ---
def error_events(t: Claims) -> DataFrame:
    return E.keyed(E.from_table(t.table("events")))


CODE = """case when user_id % 7 = 0 then case user_id % 5 when 0 then 'INGEST_001' when 1 then 'SILVER_001' when 2 then 'GOLD_001' when 3 then 'ML_001' else 'INFER_999' end else case user_id % 5 when 0 then 'INGEST_999' when 1 then 'SILVER_999' when 2 then 'GOLD_999' when 3 then 'ML_999' else 'INFER_999' end end"""
STAGE = "case coalesce(try_cast(json_extract_string(props, '$.k') as int), 0) % 3 when 0 then 'load' when 1 then 'validate' else 'write' end"
#: What a fingerprint digests: JSON with keys in order.
PAYLOAD = """'{"component": "' || component || '", "error_code": "' || error_code || '", "exception_type": ' || case when user_id % 7 = 0 then '"FileNotFoundError"' else 'null' end
 || ', "metadata": {"dataset": "set' || (user_id % 3)::varchar || '"' || case when user_id % 7 = 0 then ', "path": "/data/' || stage || '"' else '' end || '}, "stage": "' || stage || '"}'"""
EVENTS = f"""select *, substr(sha256({PAYLOAD}), 1, 20) as fingerprint, component || ' failed at ' || stage || case when user_id % 7 = 0 then ': file not found' else '' end as message from (select event_id, ts, user_id, {CODE} as error_code,
 case user_id % 5 when 0 then 'ingestion' when 1 then 'silver' when 2 then 'gold' when 3 then 'ml' else 'inference' end as component, {STAGE} as stage from events where event_type = 'error')"""
query("e1_fingerprints", f"select event_id, fingerprint from ({EVENTS})")(lambda t: error_events(t).select("event_id", "fingerprint"))
OCCUR = f"select *, row_number() over (partition by fingerprint order by ts, event_id) as occurrence from ({EVENTS})"
query("e2_occurrences", f"select event_id, cast(occurrence as int) as occurrence, occurrence >= 2 as is_repeated from ({OCCUR})")(lambda t: E.occurrences(error_events(t)).select("event_id", "occurrence", "is_repeated"))
query("e3_summary", f"select fingerprint, error_code, component, stage, count(*) as n from ({EVENTS}) group by all")(lambda t: E.summary(error_events(t)).select("fingerprint", "error_code", "component", "stage", "n"))
query("e4_repeated", f"select fingerprint, n from (select fingerprint, count(*) as n from ({EVENTS}) group by 1 having count(*) >= 2) order by n desc, fingerprint limit 10")(lambda t: E.repeated(E.summary(error_events(t))).select("fingerprint", "n"))
query("e5_classified", f"select event_id, error_code from ({EVENTS})")(lambda t: error_events(t).select("event_id", "error_code"))


def job_report(t: Claims) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "failed").when(F.col("event_id") % 3 == 1, "warnings").otherwise("success")
    return E.from_table(t.table("events")).select("component", F.col("stage").alias("dataset"), status.alias("status"), "message")


query("e6_report_events", f"select component, count(*) as n, string_agg(distinct code, ',' order by code) as codes from (select component, case when event_id % 3 = 0 then error_code when component = 'silver' then 'SILVER_002' else 'INGEST_002' end as code from ({EVENTS}) where event_id % 3 <> 2) group by 1")(lambda t: E.report_summary(E.of_reports(job_report(t))))
ERRORS = ", ".join(f"({quoted(code)}, {quoted(category)}, {quoted(severity)}, {str(retryable).lower()})" for code, category, severity, retryable, _ in catalogs.ERRORS)
query("e7_enriched", f"select event_id, error_code, category, severity, retryable from ({EVENTS}) left join (values {ERRORS}) c(error_code, category, severity, retryable) using (error_code)")(lambda t: E.enriched(error_events(t)).select("event_id", "error_code", "category", "severity", "retryable"))
query("e8_rollup", f"select component, stage, error_code, 'ERROR' as severity, count(*) as errors, count(*) filter (occurrence >= 2) as repeats from ({OCCUR}) group by all")(lambda t: E.rollup(error_events(t)))


def arriving(t: Claims, name: str) -> DataFrame:
    """Error events written as four files and read as a stream of two files a batch."""
    src = folder(t, name)
    E.from_table(t.table("events")).repartition(4).write.mode("overwrite").parquet(src)
    return streams.file_stream(t.spark, src, t.spark.read.parquet(src).schema, 2)


@query("t1_stream_summary", f"select fingerprint, error_code, component, stage, count(*) as n, any_value(message) as last_message from ({EVENTS}) group by fingerprint, error_code, component, stage")
def t1(t: Claims) -> DataFrame:
    """Error events summed up as a stream until all have arrived. The events of a fingerprint say the same."""
    out = folder(t, "t1-out")
    streams.start_summary(arriving(t, "t1-in"), out, folder(t, "t1-checkpoint")).awaitTermination()
    return streams.read_summary(t.spark, out).select("fingerprint", "error_code", "component", "stage", "n", "last_message")


@query("t1_stream_occurrences", f"select event_id, occurrence, occurrence >= 2 as is_repeated from ({OCCUR})")
def t1_occurrences(t: Claims) -> DataFrame:
    """Error events numbered as they arrive: the later half first, the earlier half after a restart; an event long after all others then lets the rest pass."""
    src, out, checkpoint = folder(t, "t1-files"), folder(t, "t1-numbered"), folder(t, "t1-numbered-checkpoint")
    events = t.layer("error_events", lambda: E.from_table(t.table("events")))
    late = F.col("event_id") % 2 == 0
    last = events.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 90 days"), "event_id": F.lit(-1).cast("long"), "stage": F.lit("end")})
    for some in (events.where(late), events.where(~late), last):
        some.repartition(3).write.mode("append").parquet(src)
        stream = streams.file_stream(t.spark, src, events.schema, 2)
        streams.start_occurrences(stream, out, checkpoint, "40 days").awaitTermination()
    return t.spark.read.parquet(out).where("event_id >= 0").select("event_id", "occurrence", "is_repeated")


@query("t2_stream_intake", "select case when billed_amount is null or billed_amount >= 0 then 'success' else 'error' end as status, count(*) as n from claims_raw group by all")
def t2(t: Claims) -> DataFrame:
    """Raw claims arriving as files, validated, built and scored by the fitted model as a stream."""
    src, out = folder(t, "t2-in"), folder(t, "t2-out")
    t.claims_raw.repartition(4).write.mode("overwrite").parquet(src)
    schema = t.spark.read.parquet(src).schema
    tables = {}
    for name, df in lookups(t).items():
        path = folder(t, f"t2-{name}")
        df.write.mode("overwrite").parquet(path)
        tables[name] = t.spark.read.parquet(path)
    streams.start_intake(streams.file_stream(t.spark, src, schema, 2), tables, out, folder(t, "t2-checkpoint"), M.scorer(M.fit(parts(t)))).awaitTermination()
    return t.spark.read.parquet(out).groupBy("status").agg(F.count("*").alias("n"))


# --- sources ---
@query("io1_csv", "select claim_id, diagnosis_code, procedure_code, date from claims_raw")
def io1(t: Claims) -> DataFrame:
    path = folder(t, "io1")
    t.claims_raw.select([F.col(c).cast("string").alias(c) for c in t.claims_raw.columns]).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/claims.csv")
    return io.read_csv(t.spark, path, "claims").select("claim_id", "diagnosis_code", "procedure_code", "date")


query("io2_provenance", "select claim_id, '2024-01-01 00:00:00' as at, 'claims.csv' as source_file from claims_raw")(lambda t: io.with_provenance(t.claims_raw, "2024-01-01 00:00:00", "claims.csv").select("claim_id", F.date_format("ingestion_timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "source_file"))


@query("io7_corpus", "select distinct source as document from documents")
def io7(t: Claims) -> DataFrame:
    """Every document written as a text file and read back as a whole: the sources whose documents all came back unchanged.

    Files are named by doc_id and the row's digest, so rows of one doc_id don't overwrite each other; equal rows share a file.
    A null text is an empty one, and an empty file may have no row when read.
    """
    path = f"{folder(t, 'io7')}/{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", "source", text), 256), 1, 32), F.lit(".txt"))
    rows = t.table("documents").select("source", text.alias("text"), F.coalesce(name, F.concat(F.lit("null-"), F.sha2(F.concat_ws("|", "source", text), 256), F.lit(".txt"))).alias("name"))
    io.write_corpus(rows, path)
    found = io.read_corpus(t.spark, path).select(F.col("source_name").alias("name"), F.sha2("text", 256).alias("found"))
    wanted = rows.select("source", "name", F.sha2("text", 256).alias("wanted"))
    whole = F.coalesce("found", F.sha2(F.lit(""), 256)) == F.col("wanted")
    return wanted.join(found, "name", "left").groupBy(F.col("source").alias("document")).agg(F.bool_and(whole).alias("whole")).where("whole").select("document")


query("io8_html_text", None)(lambda t: t.table("pages").select("page_id", html_to_text(F.col("html")).alias("text")))


@query("io10_json_events", f"select event_id, component, stage, message from ({EVENTS})")
def io10(t: Claims) -> DataFrame:
    path = folder(t, "io10")
    E.from_table(t.table("events")).write.mode("overwrite").json(path)
    return io.read_events(t.spark, path).select("event_id", "component", "stage", "message")

