"""Registered queries over layers: written under contracts, read back, and runs that report on themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Claims, shared_folder
from ..functions.text import safe_number
from ..operators import quality as Q
from ..operators import silver as S
from ..sources import io, layers
from .claims import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]


@query("io3_parquet", "select provider_id, specialty, location from providers")
def io3(t: Claims) -> DataFrame:
    """A layer written with provenance and read back without it."""
    path = shared_folder(t.spark, "io3")
    layers.write_layer(io.with_provenance(t.providers, "2024-01-01 00:00:00", "providers.csv"), path)
    return layers.read_layer(t.spark, path).select("provider_id", "specialty", "location")


@query(
    "io3_contract",
    """select claim_id, patient_id, billed_amount::double as billed_amount, (case when claim_id like '1%' then 0 else coalesce(denial_flag, 0) end)::tinyint as denial_flag, diagnosis_code_missing, procedure_code
 from claims""",
)
def io3_contract(t: Claims) -> DataFrame:
    """Claims with wrong types and nulls where none may be, written under their contract by procedure in order of id; a version before and one that fails
    leave no trace."""
    path = shared_folder(t.spark, "io3-contract")
    contract = {"claim_id": "string", "patient_id": "string", "billed_amount": "double", "denial_flag": "tinyint!", "diagnosis_code_missing": "boolean!", "procedure_code": "string"}
    flag = F.when(~F.col("claim_id").startswith("1"), F.col("denial_flag").cast("string"))
    wrong = t.claims.select("claim_id", "patient_id", F.col("billed_amount").cast("string").alias("billed_amount"), flag.alias("denial_flag"), F.col("diagnosis_code_missing").cast("string").alias("diagnosis_code_missing"), "procedure_code")
    layers.write_layer(wrong.limit(1), path, contract)
    layers.write_layer(wrong, path, contract, partitions=("procedure_code",), cluster_by=("claim_id",))
    try:
        layers.write_layer(wrong.drop("patient_id"), path, contract)
    except ValueError:
        pass
    return layers.read_layer(t.spark, path).select(*contract)


def jobs(t: Claims) -> dict[str, layers.Job]:
    counted = {
        "invalid_labels": F.count_if(~F.coalesce(safe_number(F.col("denial_flag")).isin(0.0, 1.0), F.lit(False))),
        "negatives_nullified": F.count_if(safe_number(F.col("billed_amount")) < 0),
    }
    return {
        "providers": layers.Job(lambda: t.providers_raw, S.clean_providers, shared_folder(t.spark, "run-providers"), Q.CONTRACTS["providers_silver"]),
        "claims": layers.Job(lambda: t.claims_raw, S.clean_claims, shared_folder(t.spark, "run-claims"), counted=counted),
    }


REPORTED = "select 'providers' as dataset, 'success' as status, count(*) as rows_in, count(*) as rows_out from providers_raw union all select 'claims', 'success', (select count(*) from claims_raw), (select count(*) from claims) union all select 'other', 'failed', null, null"
query("io5_run_report", REPORTED)(lambda t: layers.run_jobs(t.spark, jobs(t), ["providers", "claims", "other"]).select("dataset", "status", "rows_in", "rows_out"))
LOGGED = "select count(*) filter (denial_flag is null or denial_flag not in (0, 1)) as invalid_labels, count(*) filter (billed_amount < 0) as negatives_nullified, count(*) - count(distinct claim_id) as duplicates_removed from claims_raw"


@query("q7_run_log", LOGGED)
def q7(t: Claims) -> DataFrame:
    """The cleaning log, counted while the layer is written."""
    return layers.run_jobs(t.spark, jobs(t), ["claims"]).select(*(F.try_element_at("counted", F.lit(k)).alias(k) for k in ("invalid_labels", "negatives_nullified")), F.col("removed").alias("duplicates_removed"))
