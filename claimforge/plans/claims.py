"""Registered queries over the claims layers: cleaning, profiling, quality, analytics, gold."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Claims
from ..functions.text import title
from ..operators import analytics as A
from ..operators import gold as G
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import silver as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Claims."""
    def add(f):
        QUERIES[name] = partial(_run, f)
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _run(f, spark, sf_dir: str) -> DataFrame:
    return f(Claims(spark, sf_dir))


SILVER_COLUMNS = "claim_id, patient_id, provider_id, diagnosis_code, procedure_code, billed_amount, cast(date as varchar) as date, denial_flag, diagnosis_code_missing, procedure_code_missing, billed_amount_missing, proc_no_diag, diag_no_proc"

# --- silver ---
query("s1_safe_dates", "select claim_id, date as raw, cast(try_cast(date as date) as varchar) as parsed from claims_raw")(lambda t: t.claims_raw.select("claim_id", F.col("date").alias("raw"), S.safe_date(F.col("date")).cast("string").alias("parsed")))
query("s2_codes", "select claim_id, upper(trim(diagnosis_code)) as diagnosis_code, upper(trim(procedure_code)) as procedure_code from claims_raw")(lambda t: S.normalise_codes(t.claims_raw).select("claim_id", "diagnosis_code", "procedure_code"))
query("s3_amounts", "select claim_id, case when try_cast(billed_amount as double) >= 0 then try_cast(billed_amount as double) end as billed_amount from claims_raw")(lambda t: S.parse_amounts(t.claims_raw).select("claim_id", "billed_amount"))
# labels as text, some of them no label and some no number
query("s4_labels", "select claim_id, case when billed_amount < 0 then 2 when billed_amount is not null then denial_flag end::double as denial_flag from claims_raw")(
    lambda t: S.validate_labels(t.claims_raw.withColumn("denial_flag", F.when(F.col("billed_amount") < 0, "2").when(F.col("billed_amount").isNull(), "unknown").otherwise(F.col("denial_flag").cast("string")))).select("claim_id", "denial_flag"))
query("s5_missing_flags", "select claim_id, diagnosis_code is null as diagnosis_code_missing, procedure_code is null as procedure_code_missing, billed_amount is null as billed_amount_missing from claims_raw")(lambda t: S.missing_flags(t.claims_raw).select("claim_id", "diagnosis_code_missing", "procedure_code_missing", "billed_amount_missing"))
query("s6_sentinels", "select claim_id, coalesce(diagnosis_code, 'MISSING') as diagnosis_code, coalesce(procedure_code, 'MISSING') as procedure_code from claims_raw")(lambda t: S.fill_sentinels(t.claims_raw).select("claim_id", "diagnosis_code", "procedure_code"))
query("s7_keep_first", "select claim_id, patient_id, provider_id, diagnosis_code, procedure_code, cast(billed_amount as double) as billed_amount, date from claims_first")(lambda t: S.first_claims(t.claims_raw).select("claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", F.col("billed_amount").cast("double").alias("billed_amount"), "date"))
query("s8_cross_flags", "select claim_id, (diagnosis_code is null and procedure_code is not null) as proc_no_diag, (diagnosis_code is not null and procedure_code is null) as diag_no_proc from claims_raw")(lambda t: t.claims_raw.transform(S.missing_flags).transform(S.cross_flags).select("claim_id", "proc_no_diag", "diag_no_proc"))
query("s9_providers", "select * from providers")(lambda t: t.providers)
query("s10_diagnosis", "select * from diagnosis")(lambda t: t.diagnosis)
query("s11_cost", "select * from cost")(lambda t: t.cost)
query("s12_claims_silver", f"select {SILVER_COLUMNS} from claims")(lambda t: t.claims.withColumn("date", F.col("date").cast("string")))

# --- quality ---
BRONZE_SQL = """select 'claims' as dataset, 'claim_id' as "column", 'not_null' as "check", count(*) filter (claim_id is null) as failures from claims_raw
 union all select 'claims', 'patient_id', 'not_null', count(*) filter (patient_id is null) from claims_raw union all select 'claims', 'provider_id', 'not_null', count(*) filter (provider_id is null) from claims_raw
 union all select 'claims', 'billed_amount', 'not_negative', count(*) filter (billed_amount < 0) from claims_raw union all select 'claims', 'denial_flag', 'one_of', count(*) filter (denial_flag not in (0, 1)) from claims_raw
 union all select 'providers', 'provider_id', 'not_null', count(*) filter (provider_id is null) from providers_raw union all select 'providers', 'doctor_name', 'not_null', count(*) filter (doctor_name is null) from providers_raw
 union all select 'providers', 'specialty', 'not_null', count(*) filter (specialty is null) from providers_raw
 union all select 'diagnosis', 'diagnosis_code', 'not_null', count(*) filter (diagnosis_code is null) from diagnosis_raw union all select 'diagnosis', 'category', 'not_null', count(*) filter (category is null) from diagnosis_raw
 union all select 'diagnosis', 'severity', 'one_of', count(*) filter (severity not in ('High', 'Medium', 'Low')) from diagnosis_raw
 union all select 'cost', 'procedure_code', 'not_null', count(*) filter (procedure_code is null) from cost_raw union all select 'cost', 'average_cost', 'not_negative', count(*) filter (average_cost < 0) from cost_raw
 union all select 'cost', 'expected_cost', 'not_negative', count(*) filter (expected_cost < 0) from cost_raw union all select 'cost', 'region', 'not_null', count(*) filter (region is null) from cost_raw"""


@query("q1_bronze_validation", f"""select *, case when failures > 0 then 'warnings' else 'passed' end as status from ({BRONZE_SQL})""")
def bronze_validation(t: Claims) -> DataFrame:
    raw = {"claims": t.claims_raw, "providers": t.providers_raw, "diagnosis": t.diagnosis_raw, "cost": t.cost_raw}
    return Q.union_all([Q.validate(df, Q.BRONZE[name]).select(F.lit(name).alias("dataset"), "column", "check", "failures", "status") for name, df in raw.items()])


query("q1_bronze_failures", """select claim_id, 'billed_amount' as "column", 'not_negative' as "check", cast(cast(billed_amount as decimal(18,2)) as varchar) as "value" from claims_raw where billed_amount < 0""")(lambda t: Q.failure_cases(t.claims_raw.withColumn("billed_amount", F.col("billed_amount").cast("decimal(18,2)")), Q.BRONZE["claims"], "claim_id"))
query("q2_silver_validation", """select "column", "check", failures, case when failures > 0 then 'warnings' else 'passed' end as status from (
 select unnest(['claim_id','patient_id','provider_id','diagnosis_code','procedure_code','diagnosis_code_missing','procedure_code_missing','billed_amount_missing','proc_no_diag','diag_no_proc','billed_amount','denial_flag']) as "column",
 unnest(['not_null','not_null','not_null','not_null','not_null','not_null','not_null','not_null','not_null','not_null','not_negative','one_of']) as "check",
 unnest([count(*) filter (claim_id is null), count(*) filter (patient_id is null), count(*) filter (provider_id is null), count(*) filter (diagnosis_code is null), count(*) filter (procedure_code is null), count(*) filter (diagnosis_code_missing is null), count(*) filter (procedure_code_missing is null),
  count(*) filter (billed_amount_missing is null), count(*) filter (proc_no_diag is null), count(*) filter (diag_no_proc is null), count(*) filter (billed_amount < 0), count(*) filter (denial_flag not in (0, 1))]) as failures from claims)""")(lambda t: Q.validate(t.claims, Q.SILVER["claims"]))
RAW_COLUMNS = ["claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "date", "denial_flag"]


def per_column(table: str, facts: dict[str, str], columns: list[str], dataset: str | None = None) -> str:
    """SQL for a row per column; {c} in a fact is the column."""
    head = f"'{dataset}' as dataset, " if dataset else ""
    return " union all ".join(f"""select {head}'{c}' as "column", {", ".join(f"{f.format(c=c)} as {n}" for n, f in facts.items())} from {table}""" for c in columns)


query("q3_contract", "select procedure_code, average_cost, expected_cost, region, cast(cost_ratio as float) as cost_ratio from cost")(lambda t: Q.enforce(t.cost, Q.CONTRACTS["cost_silver"]).select("procedure_code", "average_cost", "expected_cost", "region", "cost_ratio"))
#: Columns of the features table as its contract has them; counts and amounts come as text, some of it no number.
CONTRACTED = "claim_id, try_cast(denial_flag as tinyint) as denial_flag, diagnosis_code_missing, coalesce(try_cast(case when severity_rank = 3 then 'high' else severity_rank::varchar end as tinyint), 0) as severity_rank, coalesce(patient_claim_count, 0)::int as patient_claim_count, cast(round(billed_amount_imputed, 2) as float) as billed_amount_imputed, is_high_cost::boolean as is_high_cost"


@query("q3_contract_features", f"select {CONTRACTED} from features")
def q3_features(t: Claims) -> DataFrame:
    raw = t.features.select("claim_id", F.col("denial_flag").cast("string").alias("denial_flag"), "diagnosis_code_missing", F.when(F.col("severity_rank") == 3, "high").otherwise(F.col("severity_rank").cast("string")).alias("severity_rank"), "patient_claim_count", F.round("billed_amount_imputed", 2).alias("billed_amount_imputed"), F.col("is_high_cost").cast("boolean").alias("is_high_cost"))
    return Q.enforce(raw, Q.CONTRACTS["gold_claim_features"])


@query("q3_contract_issues", "select c.*, n as rows from (values ('cost_silver', 'cost_ratio', 'float', 'double')) c(table_name, \"column\", expected, actual), (select count(*) as n from cost) union all select 'diagnosis_silver', 'severity', 'string', 'int', count(*) from diagnosis")
def q3_issues(t: Claims) -> DataFrame:
    """Contract mismatches of three tables beside the rows of the table they are about; a diagnosis table with numbers for severities has one."""
    tables = {"cost_silver": t.cost, "providers_silver": t.providers, "diagnosis_silver": t.diagnosis.withColumn("severity", F.length("severity"))}
    found = [Q.contract_issues(df, Q.CONTRACTS[name]).join(df.agg(F.count("*").alias("rows")), how="cross").select(F.lit(name).alias("table_name"), "column", "expected", "actual", "rows") for name, df in tables.items()]
    return Q.union_all(found)


AUDITED = {"null_pct": "round_even((count(*) - count({c})) * 100.0::double / count(*), 2)", "distinct_count": "count(distinct {c})", "suggestion": "case when '{c}' = 'denial_flag' then 'tinyint' when '{c}' <> 'billed_amount' and count(distinct {c}) between 1 and 10 and count(*) > 100 then 'low cardinality' else '' end"}
query("q5_audit", per_column("claims_raw", AUDITED, RAW_COLUMNS, "claims").replace("as dataset", "as table_name"))(lambda t: P.audit(t.claims_raw).select(F.lit("claims").alias("table_name"), "column", "null_pct", "distinct_count", "suggestion"))
query("q6_guard", "select (select count(*) from claims) as rows_before, (select count(*) from base) as rows_after, (select count(*) from claims) = (select count(*) from base) as holds")(lambda t: G.guard(t.claims, t.base))
query("q6_repeated_keys", "select 'cost' as table_name, procedure_code as key, count(*) as copies from cost group by procedure_code having count(*) > 1")(lambda t: G.repeated_keys({"cost": (t.cost, ["procedure_code"]), "providers": (t.providers, ["provider_id"]), "diagnosis": (t.diagnosis, ["diagnosis_code"])}).where("table_name = 'cost'").unionByName(G.repeated_keys({"providers": (t.providers, ["provider_id"])})))
query("q7_cleaning_log", "select count(*) filter (denial_flag is null or denial_flag not in (0, 1)) as invalid_labels, count(*) filter (billed_amount < 0) as negatives_nullified, count(*) - count(distinct claim_id) as duplicates_removed from claims_raw")(lambda t: S.cleaning_log(t.claims_raw))

# --- profiling ---
NULLS = {"null_count": "count(*) - count({c})", "null_pct": "round_even((count(*) - count({c})) * 100.0::double / count(*), 2)", "present_count": "count({c})"}
query("p1_null_profile", per_column("claims_raw", NULLS, RAW_COLUMNS, "claims"))(lambda t: P.null_profile(t.claims_raw, "claims"))
query("p2_duplicates", f"select (select count(*) from claims_raw) - (select count(*) from (select distinct {', '.join(RAW_COLUMNS)} from claims_raw)) as full_row_duplicates, (select count(*) - count(distinct claim_id) from claims_raw) as id_duplicates")(lambda t: P.duplicate_profile(t.claims_raw, "claim_id"))
query("p3_cardinality", per_column("claims_raw", {"distinct_count": "count(distinct {c})"}, RAW_COLUMNS))(lambda t: P.cardinality_profile(t.claims_raw))
query("p4_numeric_profile", per_column("claims_raw", {"count": "count({c})", "mean": "round_even(avg(cast({c} as double)), 2)", "std": "round_even(stddev_samp(cast({c} as double)), 2)", "min": "round_even(min(cast({c} as double)), 2)", "p25": "round_even(quantile_cont(cast({c} as double), 0.25), 2)", "p50": "round_even(quantile_cont(cast({c} as double), 0.5), 2)", "p75": "round_even(quantile_cont(cast({c} as double), 0.75), 2)", "max": "round_even(max(cast({c} as double)), 2)"}, ["billed_amount", "denial_flag"]))(lambda t: P.numeric_profile(t.claims_raw))
query("p5_value_counts", """select "column", "value", n as "count" from (select *, row_number() over (partition by "column" order by n desc, "value" asc nulls last) as r, count("value") over (partition by "column") as d from (
 select 'specialty' as "column", specialty as "value", count(*) as n from providers group by all union all select 'location', location, count(*) from providers group by all union all select 'provider_id', provider_id, count(*) from providers group by all
 union all select 'doctor_name', doctor_name, count(*) from providers group by all)) where d <= 10 and r <= 10""")(lambda t: P.value_counts(t.providers))
query("p6_profile_all", " union all ".join(per_column(name, NULLS | {"distinct_count": "count(distinct {c})"}, columns, data) for name, data, columns in (("providers_raw", "providers", ["provider_id", "doctor_name", "specialty", "location"]), ("diagnosis_raw", "diagnosis", ["diagnosis_code", "category", "severity"]), ("claims_raw", "claims", RAW_COLUMNS))))(lambda t: P.profile_all({"providers": t.providers_raw, "diagnosis": t.diagnosis_raw, "claims": t.claims_raw, "absent": None}))

# --- analytics ---
MEAN = "round_even(avg(cast(billed_amount as double)), 2)"
TOTAL = "round_even(cast(coalesce(sum(cast(billed_amount as decimal(18,2))), 0) as double), 2)"
query("a1_overview", f"""select count(*) as total_claims, count(distinct patient_id) as unique_patients, count(distinct provider_id) as unique_providers, cast(min(try_cast(date as date)) as varchar) as date_min, cast(max(try_cast(date as date)) as varchar) as date_max,
 {MEAN} as avg_billed_amount, {TOTAL} as total_billed, count(*) filter (diagnosis_code is not null and procedure_code is not null and billed_amount is not null) as claims_complete,
 count(*) filter (diagnosis_code is null and procedure_code is null and billed_amount is null) as shell_claims from claims_raw""")(lambda t: A.overview(t.claims_raw))
query("a2_null_profile", per_column("claims", NULLS, ["claim_id", "diagnosis_code", "procedure_code", "billed_amount", "date"], "claims_silver"))(lambda t: P.null_profile(t.claims.select("claim_id", "diagnosis_code", "procedure_code", "billed_amount", "date"), "claims_silver"))
query("a3_by_provider", f"select a.*, p.specialty, p.location from (select provider_id, count(claim_id) as claim_count, {MEAN} as avg_billed, {TOTAL} as total_billed from claims_raw group by provider_id) a left join providers_raw p using (provider_id)")(lambda t: A.by_provider(t.claims_raw, t.providers_raw))
query("a4_by_diagnosis", f"select a.*, d.category, d.severity from (select upper(trim(diagnosis_code)) as diagnosis_code, count(claim_id) as claim_count, {MEAN} as avg_billed from claims_raw group by 1) a left join diagnosis d using (diagnosis_code)")(lambda t: A.by_diagnosis(S.normalise_codes(t.claims_raw), t.diagnosis))
query("a5_by_specialty", f"select p.specialty, count(claim_id) as claim_count, {MEAN} as avg_billed, {TOTAL} as total_billed from claims_raw c left join providers_raw p using (provider_id) group by p.specialty")(lambda t: A.by_specialty(t.claims_raw, t.providers_raw))
query("a6_timeline", "select cast(try_cast(date as date) as varchar) as date_str, count(claim_id) as claim_count from claims_raw where try_cast(date as date) is not null group by 1")(lambda t: A.timeline(t.claims_raw))
COST_ANALYSIS = f"""select a.procedure_code, c.region, c.expected_cost, a.claim_count, a.avg_billed, a.min_billed, a.max_billed, round_even((a.mean - c.expected_cost) * 100 / c.expected_cost, 2) as deviation_pct
 from (select procedure_code, count(claim_id) as claim_count, avg(cast(billed_amount as double)) as mean, {MEAN} as avg_billed, round_even(min(cast(billed_amount as double)), 2) as min_billed, round_even(max(cast(billed_amount as double)), 2) as max_billed from claims where billed_amount is not null group by 1) a left join cost c using (procedure_code)"""
query("a7_cost_analysis", COST_ANALYSIS)(lambda t: A.cost_analysis(t.claims, t.cost))
query("a8_high_cost_claims", "select claim_id, procedure_code, location, billed_amount, round(expected_cost, 4) as expected_cost, cost_match_level, billed_deviation_pct from base where billed_deviation_pct > 0 order by billed_deviation_pct desc, claim_id limit 20")(lambda t: A.above_benchmark(t.base).withColumn("expected_cost", F.round("expected_cost", 4)))
query("a8_high_cost_by_region", "select claim_id, c.procedure_code, k.region, billed_amount, k.expected_cost, round_even((billed_amount - k.expected_cost) * 100 / k.expected_cost, 2) as deviation_pct from claims c join cost k using (procedure_code) where billed_amount is not null and round_even((billed_amount - k.expected_cost) * 100 / k.expected_cost, 2) > 100 order by deviation_pct desc, claim_id, region limit 20")(lambda t: A.high_cost(t.claims, t.cost))
PCT = "round_even(count(*) filter ({0}) * 100.0::double / count(*), {1})"
query("a9_cleaning_impact", f"""select b.*, s.*, bronze_rows - silver_rows as rows_removed from (select count(*) as bronze_rows, {PCT.format('diagnosis_code is null', 2)} as bronze_diag_null_pct, {PCT.format('procedure_code is null', 2)} as bronze_proc_null_pct, {PCT.format('billed_amount is null', 2)} as bronze_amount_null_pct from claims_raw) b,
 (select count(*) as silver_rows, {PCT.format('diagnosis_code is null', 2)} as silver_diag_null_pct, {PCT.format('procedure_code is null', 2)} as silver_proc_null_pct, {PCT.format('billed_amount is null', 2)} as silver_amount_null_pct,
 count(*) filter (diagnosis_code_missing) as flagged_diag, count(*) filter (procedure_code_missing) as flagged_proc, count(*) filter (billed_amount_missing) as flagged_amount, count(*) filter (proc_no_diag) as proc_no_diag, count(*) filter (diag_no_proc) as diag_no_proc, {PCT.format('date is not null', 2)} as date_parsed_pct from claims) s""")(lambda t: A.cleaning_impact(t.claims_raw, t.claims))
query("a10_completeness", """select l.completeness_level, l.missing_count, coalesce(n, 0) as claim_count, round_even(coalesce(n, 0) * 100.0::double / (select count(*) from claims), 1) as pct from
 (select unnest(['Complete (0 missing)', '1 field missing', '2 fields missing', 'Shell (all 3 missing)']) as completeness_level, unnest([0, 1, 2, 3]) as missing_count) l
 left join (select diagnosis_code_missing::int + procedure_code_missing::int + billed_amount_missing::int as m, count(*) as n from claims group by 1) on m = missing_count""")(lambda t: A.completeness(t.claims))
query("a11_violations", " union all ".join(f"select '{label}' as violation, '{severity}' as severity, count(*) filter ({c}) as claim_count, {PCT.format(c, 1)} as pct_of_claims from claims" for c, label, severity in A.VIOLATIONS))(lambda t: A.violations(t.claims))
RISK = f"""select a.*, total_violations_ as total_violations, round_even(total_violations_ * 100.0::double / total_claims, 1) as violation_rate_pct, p.specialty, p.location from (select provider_id, count(claim_id) as total_claims, {MEAN} as avg_billed, {", ".join(f"count(*) filter ({c}) as {c}" for c in A.FLAGS)}
 from claims where provider_id is not null group by provider_id) a, lateral (select {" + ".join("a." + c for c in A.FLAGS)} as total_violations_) v left join providers p on a.provider_id = p.provider_id"""
query("a12_provider_risk", RISK)(lambda t: A.provider_risk(t.claims, t.providers))
HIST = """select bin, n from (select b.bin, coalesce(h.n, 0) as n from (select unnest(range({bins})) as bin) b left join (select least({bins} - 1, cast(floor((x - a) / (b - a) * {bins}) as int)) as bin, count(*) as n from (select {x} as x from {table} where {x} is not null), (select {low} as a, {high} as b from {table}) group by 1) h using (bin))"""
query("a13_billed_distribution", f"select cast(bin as int) as bin, n as claim_count from ({HIST.format(bins=12, x='billed_amount', table='claims', low='min(billed_amount)', high='max(billed_amount)')})")(lambda t: A.billed_distribution(t.claims).select("bin", "claim_count"))
query("a14_outcomes", "select case denial_flag when 1 then 'denied' when 0 then 'approved' else 'unknown' end as outcome, count(*) as claims, (select round_even(avg(denial_flag) * 100, 2) from claims) as denial_rate_pct from claims group by 1")(lambda t: A.outcomes(t.claims))
query("a15_dimension_counts", " union all ".join(f"select '{d}' as dimension, coalesce({d}, 'Unknown') as value, count(*) as claims from base group by 2" for d in ("specialty", "location", "severity", "cost_match_level")))(lambda t: A.dimension_counts(t.base))
query("a15_top_specialties", "select coalesce(specialty, 'Unknown') as value, count(*) as claims from base group by 1 order by claims desc, value limit 6")(lambda t: A.top_specialties(t.base))
query("a16_amount_snapshot", "select round_even(quantile_cont(cast(billed_amount as double), 0.5), 2) as median_billed, round_even(quantile_cont(cast(billed_amount as double), 0.9), 2) as p90_billed from claims")(lambda t: A.amount_snapshot(t.claims))
query("a17_benchmark_spread", f"select round_even(median(d), 2) as median_deviation_pct, count(*) filter (d > 50) as procedures_over from (select procedure_code, max(deviation_pct) as d from ({COST_ANALYSIS}) where deviation_pct is not null group by 1)")(lambda t: A.benchmark_spread(t.claims, t.cost))
query("a18_flag_arithmetic", f"""select tier, providers, shell_claims, amount_without_codes from (select case when violation_rate_pct > 50 then 'red' when violation_rate_pct > 25 then 'amber' else 'green' end as tier, count(*) as providers from ({RISK}) group by 1),
 (select count(*) filter (diagnosis_code_missing and procedure_code_missing and billed_amount_missing) as shell_claims, count(*) filter (not billed_amount_missing and diagnosis_code_missing and procedure_code_missing) as amount_without_codes from claims)""")(lambda t: A.flag_arithmetic(t.claims, t.providers))

# --- gold ---
ROUND4 = lambda df, *columns: df.withColumns({c: F.round(c, 4) for c in columns})
COSTS = "round(expected_cost, 4) as expected_cost, round(average_cost, 4) as average_cost, round(cost_ratio, 4) as cost_ratio"
query("g1_regional_benchmark", f"select procedure_code, region, {COSTS} from regional")(lambda t: ROUND4(G.regional_benchmark(t.cost), "expected_cost", "average_cost", "cost_ratio"))
query("g2_procedure_benchmark", f"select procedure_code, {COSTS} from by_procedure")(lambda t: ROUND4(G.procedure_benchmark(t.cost), "expected_cost", "average_cost", "cost_ratio"))
query("g3_references", "select claim_id, specialty, location, category, severity from enriched")(lambda t: G.add_references(t.claims, t.providers, t.diagnosis).select("claim_id", "specialty", "location", "category", "severity"))
query("g4_tiered_benchmark", "select claim_id, round(expected_cost, 4) as expected_cost, cost_match_level from base")(lambda t: ROUND4(t.base.select("claim_id", "expected_cost", "cost_match_level"), "expected_cost"))
query("g5_deviation", "select claim_id, billed_deviation_pct from base")(lambda t: t.base.select("claim_id", "billed_deviation_pct"))
query("g6_label", "select claim_id, denial_flag, cast(null as double) as denial_risk_score, 'provided' as label_source from base")(lambda t: t.base.select("claim_id", "denial_flag", "denial_risk_score", "label_source"))
query("g7_synthetic_score", """select claim_id, round_even(s, 6) as denial_risk_score, (round(s, 9) >= 0.5)::int as denial_flag from (select claim_id, least(greatest(0.25 * diagnosis_code_missing::int::double + 0.20::double * proc_no_diag::int + 0.18::double * procedure_code_missing::int + 0.15::double * billed_amount_missing::int
 + 0.12::double * diag_no_proc::int + 0.10::double * ((hh // 2) + (hh % 2) * ((hh // 2) % 2)) / 10000.0::double, 0::double), 1::double) as s from (select *, cast(round(least(greatest(coalesce(billed_deviation_pct, 0), 0), 200) * 100) as bigint) as hh from base))""")(lambda t: G.synthetic_score(t.base, digits=6).select("claim_id", "denial_risk_score", "denial_flag"))
query("g8_provider_aggregates", "select * from provider_agg")(lambda t: G.provider_aggregates(t.base))
query("g9_patient_counts", "select * from patient_agg")(lambda t: G.patient_counts(t.base))
query("g10_encodings", "select claim_id, severity_encoded, severity_rank, specialty_encoded, cost_match_encoded from features")(lambda t: G.encode(t.base).select("claim_id", "severity_encoded", "severity_rank", "specialty_encoded", "cost_match_encoded"))
query("g11_imputation", "select claim_id, round(billed_amount_imputed, 4) as billed_amount_imputed, amount_imputation_strategy from imputed")(lambda t: ROUND4(G.impute_amounts(t.base).select("claim_id", "billed_amount_imputed", "amount_imputation_strategy"), "billed_amount_imputed"))
query("g12_log_amounts", "select claim_id, round(log_billed_amount, 6) as log_billed_amount, round(log_billed_amount_imputed, 6) as log_billed_amount_imputed from features")(lambda t: t.base.transform(G.impute_amounts).transform(G.log_amounts).select("claim_id", F.round("log_billed_amount", 6).alias("log_billed_amount"), F.round("log_billed_amount_imputed", 6).alias("log_billed_amount_imputed")))
query("g13_capped_deviations", "select claim_id, billed_deviation_capped, billed_deviation_imputed_capped from features")(lambda t: t.base.transform(G.impute_amounts).transform(G.cap_deviations).select("claim_id", "billed_deviation_capped", "billed_deviation_imputed_capped"))
query("g14_high_cost", "select claim_id, is_high_cost from features")(lambda t: t.base.transform(G.impute_amounts).transform(G.flag_high_cost).select("claim_id", "is_high_cost"))
G15 = ["claim_id", "provider_claim_count", "provider_avg_billed", "provider_violation_rate", "patient_claim_count", "severity_encoded", "severity_rank", "specialty_encoded", "cost_match_encoded", "amount_imputation_strategy", "billed_deviation_imputed_pct", "billed_deviation_capped", "billed_deviation_imputed_capped", "is_high_cost"]
query("g15_features", f"select {', '.join(G15)} from features")(lambda t: t.features.select(*G15))


class Lookups(Mapping):
    """Tables for scoring by name; each is written as a layer when it is first asked for, so that a query pays for those that it reads."""

    def __init__(self, t: Claims):
        self.t, self.made = t, G.lookup_tables(t.features, t.providers, t.diagnosis, t.cost)

    def __getitem__(self, name: str) -> DataFrame:
        return self.t.layer(f"lookup_{name}", lambda: self.made[name])

    def __iter__(self):
        return iter(self.made)

    def __len__(self) -> int:
        return len(self.made)


def lookups(t: Claims) -> Mapping[str, DataFrame]:
    return Lookups(t)


query("g17_amount_medians", "select procedure_code, round_even(procedure_median, 6) as procedure_median from medians")(lambda t: lookups(t)["amount_medians"])
query("g17_provider_history", "select a.*, p.specialty, p.location from provider_agg a left join providers p using (provider_id)")(lambda t: lookups(t)["provider_history"])
query("g17_patient_counts", "select * from patient_agg")(lambda t: lookups(t)["patient_counts"])
query("g17_diagnosis", "select *, case severity when 'Low' then 1 when 'Medium' then 2 when 'High' then 3 else 0 end as severity_rank from diagnosis")(lambda t: lookups(t)["diagnosis"])
query("g17_scalars", "select round(median(billed_amount), 4) as global_median, round(quantile_cont(expected_cost, 0.75), 4) as expected_cost_p75 from base")(lambda t: ROUND4(lookups(t)["scalars"], "global_median", "expected_cost_p75"))
query("g18_run_report", """select metric, value from (select unnest(['rows', 'denied', 'denial_rate_pct', 'cost_match_missing', 'cost_match_procedure_avg', 'cost_match_regional']) as metric, unnest([count(*)::double, sum(denial_flag)::double, round_even(avg(denial_flag) * 100, 1),
 count(*) filter (cost_match_level = 'missing')::double, count(*) filter (cost_match_level = 'procedure_avg')::double, count(*) filter (cost_match_level = 'regional')::double]) as value from base)""")(lambda t: G.run_report(t.base))
