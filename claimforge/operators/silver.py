"""Cleaning: bronze tables to silver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MISSING, UNKNOWN, code, ratio, safe_number, title

#: The total order that decides which of several rows with one id is the first.
CLAIM_ORDER = ("billed_amount", "date", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "denial_flag")
PROVIDER_ORDER = ("doctor_name", "specialty", "location")


def keep_first(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """One row a key: the first by an explicit total order, nulls last."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def safe_date(c: Column) -> Column:
    return c.try_cast("date")


def safe_amount(c: Column) -> Column:
    """A number that isn't negative, or null."""
    n = safe_number(c)
    return F.when(n >= 0, n)


def parse_dates(claims: DataFrame) -> DataFrame:
    return claims.withColumn("date", safe_date(F.col("date")))


def normalise_codes(claims: DataFrame) -> DataFrame:
    return claims.withColumns({c: code(F.col(c)) for c in ("diagnosis_code", "procedure_code")})


def parse_amounts(claims: DataFrame) -> DataFrame:
    return claims.withColumn("billed_amount", safe_amount(F.col("billed_amount")))


def label_is_valid(claims: DataFrame) -> DataFrame:
    """One row: whether every label is 0 or 1."""
    n = safe_number(F.col("denial_flag"))
    return claims.agg(F.coalesce(F.bool_and(F.coalesce(n.isin(0.0, 1.0), F.lit(False))), F.lit(True)).alias("valid"))


def validate_labels(claims: DataFrame) -> DataFrame:
    """Every numeric label is kept, valid or not; what is no number becomes null. The column holds whole numbers where it came so or where all
    labels are 0 or 1 (asked once), doubles otherwise."""
    kind = dict(claims.dtypes).get("denial_flag")
    if kind is None or kind in ("tinyint", "smallint", "int", "bigint"):
        return claims
    out = claims.withColumn("denial_flag", safe_number(F.col("denial_flag")))
    return out.withColumn("denial_flag", F.col("denial_flag").cast("int")) if label_is_valid(claims).first().valid else out


def missing_flags(claims: DataFrame) -> DataFrame:
    """Before sentinels are filled in."""
    return claims.withColumns({f"{c}_missing": F.col(c).isNull() for c in ("diagnosis_code", "procedure_code", "billed_amount")})


def fill_sentinels(claims: DataFrame) -> DataFrame:
    return claims.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in ("diagnosis_code", "procedure_code")})


def cross_flags(claims: DataFrame) -> DataFrame:
    d, p = F.col("diagnosis_code_missing"), F.col("procedure_code_missing")
    return claims.withColumn("proc_no_diag", d & ~p).withColumn("diag_no_proc", p & ~d)


def first_claims(claims: DataFrame) -> DataFrame:
    return keep_first(claims, "claim_id", CLAIM_ORDER)


def clean_claims(raw: DataFrame) -> DataFrame:
    """The whole claims job. Deduplication reads raw rows, so its order is that of the source."""
    out = raw.transform(first_claims).transform(parse_dates).transform(normalise_codes).transform(parse_amounts).transform(validate_labels)
    return out.transform(missing_flags).transform(fill_sentinels).transform(cross_flags)


def clean_providers(raw: DataFrame) -> DataFrame:
    out = keep_first(raw, "provider_id", PROVIDER_ORDER)
    place = title(F.trim("location"))
    return out.select("provider_id", F.trim("doctor_name").alias("doctor_name"), title(F.trim("specialty")).alias("specialty"), F.coalesce(place, F.lit(UNKNOWN)).alias("location"), F.col("location").isNull().alias("location_missing"))


def clean_diagnosis(raw: DataFrame) -> DataFrame:
    return raw.select(code(F.col("diagnosis_code")).alias("diagnosis_code"), title(F.trim("category")).alias("category"), title(F.trim("severity")).alias("severity"))


def clean_cost(raw: DataFrame) -> DataFrame:
    average, expected = safe_number(F.col("average_cost")), safe_number(F.col("expected_cost"))
    return raw.select(code(F.col("procedure_code")).alias("procedure_code"), title(F.trim("region")).alias("region"), average.alias("average_cost"), expected.alias("expected_cost"), ratio(average, expected, 4).alias("cost_ratio"))


def cleaning_log(raw: DataFrame) -> DataFrame:
    """One row: invalid labels, negative amounts, duplicate ids removed."""
    n = safe_number(F.col("denial_flag"))
    return raw.agg(
        F.count_if(~F.coalesce(n.isin(0.0, 1.0), F.lit(False))).alias("invalid_labels"),
        F.count_if(safe_number(F.col("billed_amount")) < 0).alias("negatives_nullified"),
        (F.count("*") - F.countDistinct("claim_id")).alias("duplicates_removed"),
    )
