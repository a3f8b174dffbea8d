"""SQL twins: the claims layers as common table expressions that DuckDB runs over the same Parquet tables."""

from __future__ import annotations

from ..fixtures import CLAIMS, COST, DIAGNOSIS, PROVIDERS


def title(c: str) -> str:
    return rf"array_to_string([upper(x[1]) || x[2:] for x in regexp_extract_all(lower({c}), '(\p{{L}}+|\P{{L}}+)')], '')"


ORDER = "billed_amount asc nulls last, date asc nulls last, patient_id asc nulls last, provider_id asc nulls last, diagnosis_code asc nulls last, procedure_code asc nulls last, denial_flag asc nulls last"
FLAG_SUM = "(diagnosis_code_missing::int + procedure_code_missing::int + billed_amount_missing::int + proc_no_diag::int + diag_no_proc::int)"

LAYERS = {
    "claims_raw": CLAIMS,
    "providers_raw": PROVIDERS,
    "diagnosis_raw": DIAGNOSIS,
    "cost_raw": COST,
    "claims_first": f"select * exclude (n) from (select *, row_number() over (partition by claim_id order by {ORDER}) as n from claims_raw) where n = 1",
    "claims_parsed": """select claim_id, patient_id, provider_id, upper(trim(diagnosis_code)) as diagnosis_code, upper(trim(procedure_code)) as procedure_code,
        case when try_cast(billed_amount as double) >= 0 then try_cast(billed_amount as double) end as billed_amount, try_cast(date as date) as date, denial_flag from claims_first""",
    "claims": """select claim_id, patient_id, provider_id, coalesce(diagnosis_code,'MISSING') as diagnosis_code, coalesce(procedure_code,'MISSING') as procedure_code, billed_amount, date, denial_flag,
        diagnosis_code is null as diagnosis_code_missing, procedure_code is null as procedure_code_missing, billed_amount is null as billed_amount_missing,
        (diagnosis_code is null and procedure_code is not null) as proc_no_diag, (diagnosis_code is not null and procedure_code is null) as diag_no_proc from claims_parsed""",
    "providers": f"select provider_id, trim(doctor_name) as doctor_name, {title('trim(specialty)')} as specialty, coalesce({title('trim(location)')},'Unknown') as location, location is null as location_missing from providers_raw",
    "diagnosis": f"select upper(trim(diagnosis_code)) as diagnosis_code, {title('trim(category)')} as category, {title('trim(severity)')} as severity from diagnosis_raw",
    "cost": f"select upper(trim(procedure_code)) as procedure_code, {title('trim(region)')} as region, average_cost, expected_cost, round_even(average_cost / expected_cost, 4) as cost_ratio from cost_raw",
    "regional": "select procedure_code, region, avg(expected_cost) as expected_cost, avg(average_cost) as average_cost, avg(cost_ratio) as cost_ratio from cost group by all",
    "by_procedure": "select procedure_code, avg(expected_cost) as expected_cost, avg(average_cost) as average_cost, avg(cost_ratio) as cost_ratio from cost group by all",
    "enriched": "select c.*, p.specialty, p.location, d.category, d.severity from claims c left join providers p using (provider_id) left join diagnosis d using (diagnosis_code)",
    "base": """select e.*, coalesce(r.expected_cost, b.expected_cost) as expected_cost, coalesce(r.average_cost, b.average_cost) as average_cost, coalesce(r.cost_ratio, b.cost_ratio) as cost_ratio,
        case when r.expected_cost is not null then 'regional' when b.expected_cost is not null then 'procedure_avg' else 'missing' end as cost_match_level,
        round_even((e.billed_amount - coalesce(r.expected_cost, b.expected_cost)) * 100 / coalesce(r.expected_cost, b.expected_cost), 2) as billed_deviation_pct
        from enriched e left join regional r on e.procedure_code = r.procedure_code and e.location = r.region left join by_procedure b on e.procedure_code = b.procedure_code""",
    "provider_agg": f"select provider_id, count(*) as provider_claim_count, round_even(avg(billed_amount), 2) as provider_avg_billed, round_even(avg({FLAG_SUM}), 4) as provider_violation_rate from base where provider_id is not null group by provider_id",
    "patient_agg": "select patient_id, count(*) as patient_claim_count from base where patient_id is not null group by patient_id",
    "medians": "select procedure_code, median(billed_amount) as procedure_median from base where billed_amount is not null group by procedure_code",
    "imputed": """select b.*, coalesce(b.billed_amount, m.procedure_median, g.g, 0) as billed_amount_imputed,
        case when b.billed_amount is not null then 'original' when m.procedure_median is not null then 'procedure_median' else 'global_median' end as amount_imputation_strategy
        from base b left join medians m using (procedure_code), (select median(billed_amount) as g from base) g""",
    "features": """select i.*, pa.provider_claim_count, pa.provider_avg_billed, pa.provider_violation_rate, pt.patient_claim_count,
        case severity when 'Low' then 1 when 'Medium' then 2 when 'High' then 2 else 0 end as severity_encoded, case severity when 'Low' then 1 when 'Medium' then 2 when 'High' then 3 else 0 end as severity_rank,
        case specialty when 'Neurology' then 1 when 'Cardiology' then 2 when 'Orthopedic' then 3 when 'General' then 4 else 0 end as specialty_encoded,
        case cost_match_level when 'regional' then 2 when 'procedure_avg' then 1 else 0 end as cost_match_encoded,
        case when billed_amount is not null then ln(1 + greatest(billed_amount, 0)) end as log_billed_amount, ln(1 + greatest(billed_amount_imputed, 0)) as log_billed_amount_imputed,
        round_even((billed_amount_imputed - expected_cost) * 100 / expected_cost, 2) as billed_deviation_imputed_pct,
        case when billed_deviation_pct is not null then least(greatest(billed_deviation_pct, -100), 500) end as billed_deviation_capped,
        case when expected_cost is not null then least(greatest(round_even((billed_amount_imputed - expected_cost) * 100 / expected_cost, 2), -100), 500) end as billed_deviation_imputed_capped,
        case when billed_amount_imputed > (select quantile_cont(expected_cost, 0.75) from base) then 1 else 0 end as is_high_cost
        from imputed i left join provider_agg pa using (provider_id) left join patient_agg pt using (patient_id)""",
    "scored": """select concat(l_orderkey::varchar, '-', l_linenumber::varchar, '-', l_partkey::varchar, '-', l_suppkey::varchar) as row_id, (l_returnflag = 'R')::int as label,
        least(1.0::double, round((l_discount::double * 5 + l_tax::double * 4 + (l_quantity::double % 10) / 50) / 1.02, 3)) as score from lineitem""",
}


def needs(sql: str) -> list[str]:
    """Layers that a query reads, itself or through others, in order of definition."""
    import re

    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop())) & set(LAYERS) - found
        found |= words
        todo += [LAYERS[w] for w in words]
    return [name for name in LAYERS if name in found]


def with_layers(sql: str) -> str:
    used = needs(sql)
    if not used:
        return sql
    head = ", ".join(f"{name} as ({LAYERS[name]})" for name in used)
    return f"with {head}, {sql.strip()[5:]}" if sql.strip().lower().startswith("with ") else f"with {head} {sql}"
