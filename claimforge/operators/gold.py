"""Enrichment, labels and features: silver tables to gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantiles
from ..functions.text import clip, ratio, safe_number

FLAGS = ("diagnosis_code_missing", "procedure_code_missing", "billed_amount_missing", "proc_no_diag", "diag_no_proc")
#: Weights of the flags in the synthetic score, and of the capped deviation.
FLAG_WEIGHTS = {"diagnosis_code_missing": 0.25, "proc_no_diag": 0.20, "procedure_code_missing": 0.18, "billed_amount_missing": 0.15, "diag_no_proc": 0.12}
DEVIATION_WEIGHT, DENY_FROM, NOISE = 0.10, 0.5, 0.10
#: Ordinal codes (two severity scales are in use).
SEVERITY_ENCODED = {"Low": 1, "Medium": 2, "High": 2}
SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3}
SPECIALTY = {"Neurology": 1, "Cardiology": 2, "Orthopedic": 3, "General": 4}
COST_MATCH = {"missing": 0, "procedure_avg": 1, "regional": 2}


def encoded(column: str, codes: dict[str, int]):
    out = F.lit(0)
    for name, n in codes.items():
        out = F.when(F.col(column) == name, n).otherwise(out)
    return out


def regional_benchmark(cost: DataFrame) -> DataFrame:
    return cost.groupBy("procedure_code", "region").agg(*(F.avg(c).alias(c) for c in ("expected_cost", "average_cost", "cost_ratio")))


def procedure_benchmark(cost: DataFrame) -> DataFrame:
    return cost.groupBy("procedure_code").agg(*(F.avg(c).alias(c) for c in ("expected_cost", "average_cost", "cost_ratio")))


def add_references(claims: DataFrame, providers: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Left joins with providers and diagnoses; both sides are unique by key, so rows stay as many. Whether they are
    broadcast is left to the optimiser, which knows their size."""
    out = claims.join(providers.select("provider_id", "specialty", "location"), "provider_id", "left")
    return out.join(diagnosis.select("diagnosis_code", "category", "severity"), "diagnosis_code", "left")


def add_benchmark(claims: DataFrame, cost: DataFrame) -> DataFrame:
    """The tiered benchmark: (procedure, location) first, then procedure alone."""
    costs = ("expected_cost", "average_cost", "cost_ratio")
    near = regional_benchmark(cost).select("procedure_code", F.col("region").alias("location"), *(F.col(c).alias(f"near_{c}") for c in costs))
    far = procedure_benchmark(cost).select("procedure_code", *(F.col(c).alias(f"far_{c}") for c in costs))
    out = claims.join(near, ["procedure_code", "location"], "left").join(far, "procedure_code", "left")
    level = F.when(F.col("near_expected_cost").isNotNull(), "regional").when(F.col("far_expected_cost").isNotNull(), "procedure_avg").otherwise("missing")
    return out.withColumns({"cost_match_level": level} | {c: F.coalesce(f"near_{c}", f"far_{c}") for c in costs}).drop(*(f"{side}_{c}" for side in ("near", "far") for c in costs))


def add_deviation(claims: DataFrame, amount: str = "billed_amount", out: str = "billed_deviation_pct") -> DataFrame:
    return claims.withColumn(out, ratio(F.col(amount) - F.col("expected_cost"), F.col("expected_cost"), 2, 100))


def build_base(claims: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame) -> DataFrame:
    """Claims with references, benchmark and deviation. Fails where a reference has a key twice, which alone could change the number of rows."""
    twice = repeated_keys({"providers": (providers, ["provider_id"]), "diagnosis": (diagnosis, ["diagnosis_code"])}).limit(5).collect()
    if twice:
        raise ValueError(f"reference keys that would multiply claims: {[(r.table_name, r.key, r.copies) for r in twice]}")
    return claims.transform(add_references, providers, diagnosis).transform(add_benchmark, cost).transform(add_deviation)


def repeated_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table_name, keys, copies): reference keys that would multiply claims in a join; empty when the guard holds."""
    parts = [df.groupBy(*keys).count().where("count > 1").select(F.lit(name).alias("table_name"), F.concat_ws("|", *keys).alias("key"), F.col("count").alias("copies")) for name, (df, keys) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: claims before and after enrichment, and whether they are as many."""
    counts = before.agg(F.count("*").alias("rows_before")).join(after.agg(F.count("*").alias("rows_after")), how="cross")
    return counts.withColumn("holds", F.col("rows_before") == F.col("rows_after"))


def synthetic_score(base: DataFrame, noise: float = 0.0, digits: int = 4) -> DataFrame:
    """Weighted flags plus the capped deviation; noise is normal, drawn from a hash of the claim id, so order doesn't matter."""
    raw = F.lit(0.0)
    for flag, weight in FLAG_WEIGHTS.items():
        raw = raw + F.lit(weight) * F.col(flag).cast("int")
    raw = raw + F.lit(DEVIATION_WEIGHT) * F.bround(F.round(clip(F.coalesce("billed_deviation_pct", F.lit(0.0)), 0.0, 200.0) * 100) / 2) / 10000
    if noise:
        unit = lambda seed: (F.pmod(F.xxhash64("claim_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        raw = raw + F.lit(noise) * F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))
    score = clip(raw, 0.0, 1.0)
    return base.withColumns({"denial_risk_score": F.bround(score, digits), "denial_flag": (F.round(score, 9) >= DENY_FROM).cast("int"), "label_source": F.lit("synthetic")})


def resolve_label(base: DataFrame, noise: float = NOISE) -> DataFrame:
    """The provided label where every row has a valid one, a synthetic one otherwise; decided by a one-row aggregate."""
    if "denial_flag" not in base.columns:
        return synthetic_score(base, noise)
    n = safe_number(F.col("denial_flag"))
    verdict = base.agg(F.coalesce(F.bool_and(F.coalesce(n.isin(0.0, 1.0), F.lit(False))), F.lit(False)).alias("provided"))
    made = synthetic_score(base.withColumn("given", n.cast("int")), noise)
    out = made.join(F.broadcast(verdict), how="cross")
    pick = lambda a, b: F.when(F.col("provided"), a).otherwise(b)
    return out.withColumns({"denial_flag": pick(F.col("given"), F.col("denial_flag")), "denial_risk_score": pick(F.lit(None).cast("double"), F.col("denial_risk_score")), "label_source": pick(F.lit("provided"), F.lit("synthetic"))}).drop("given", "provided")


def provider_aggregates(base: DataFrame) -> DataFrame:
    """Claims, mean amount and mean flags of each provider; rows without a provider have none."""
    flags = sum((F.col(f).cast("int") for f in FLAGS[1:]), F.col(FLAGS[0]).cast("int"))
    return base.where("provider_id is not null").groupBy("provider_id").agg(F.count("*").alias("provider_claim_count"), F.bround(F.avg("billed_amount"), 2).alias("provider_avg_billed"), F.bround(F.avg(flags), 4).alias("provider_violation_rate"))


def patient_counts(base: DataFrame) -> DataFrame:
    return base.where("patient_id is not null").groupBy("patient_id").agg(F.count("*").alias("patient_claim_count"))


def encode(base: DataFrame) -> DataFrame:
    return base.withColumns({"severity_encoded": encoded("severity", SEVERITY_ENCODED), "severity_rank": encoded("severity", SEVERITY_RANK), "specialty_encoded": encoded("specialty", SPECIALTY), "cost_match_encoded": encoded("cost_match_level", COST_MATCH)})


def procedure_medians(base: DataFrame) -> DataFrame:
    return quantiles(base, F.col("billed_amount"), ("procedure_code",), procedure_median=0.5)


def overall(base: DataFrame) -> DataFrame:
    """One row: the median amount (0 without amounts) and the upper quartile of the expected cost over claim rows, from one pass."""
    each = F.array(F.struct(F.lit("amount").alias("kind"), F.col("billed_amount").cast("double").alias("x")), F.struct(F.lit("expected").alias("kind"), F.col("expected_cost").cast("double").alias("x")))
    found = quantiles(base.select(F.explode(each).alias("e")).select("e.*"), F.col("x"), ("kind",), median=0.5, p75=0.75)
    of = lambda kind, share: F.max(F.when(F.col("kind") == kind, F.col(share)))
    return found.agg(F.coalesce(of("amount", "median"), F.lit(0.0)).alias("global_median"), of("expected", "p75").alias("expected_p75"))


def global_median(base: DataFrame) -> DataFrame:
    return quantiles(base, F.col("billed_amount"), global_median=0.5).na.fill(0.0)


def impute_amounts(base: DataFrame, of_all: DataFrame | None = None) -> DataFrame:
    """The amount itself, else its procedure's median, else the median of all (0 if there is none); exact medians. of_all is a row of overall()
    whose other columns stay, where the caller needs them too."""
    out = base.join(procedure_medians(base), "procedure_code", "left").join(F.broadcast(global_median(base) if of_all is None else of_all), how="cross")
    strategy = F.when(F.col("billed_amount").isNotNull(), "original").when(F.col("procedure_median").isNotNull(), "procedure_median").otherwise("global_median")
    return out.withColumns({"billed_amount_imputed": F.coalesce("billed_amount", "procedure_median", "global_median"), "amount_imputation_strategy": strategy}).drop("procedure_median", "global_median")


def log_amounts(df: DataFrame) -> DataFrame:
    raw = F.when(F.col("billed_amount").isNotNull(), F.log1p(F.greatest(F.col("billed_amount"), F.lit(0.0))))
    return df.withColumns({"log_billed_amount": raw, "log_billed_amount_imputed": F.log1p(F.greatest(F.col("billed_amount_imputed"), F.lit(0.0)))})


def cap_deviations(df: DataFrame) -> DataFrame:
    out = add_deviation(df, "billed_amount_imputed", "billed_deviation_imputed_pct")
    return out.withColumns({"billed_deviation_capped": clip(F.col("billed_deviation_pct"), -100.0, 500.0), "billed_deviation_imputed_capped": clip(F.col("billed_deviation_imputed_pct"), -100.0, 500.0)})


def flag_high_cost(df: DataFrame) -> DataFrame:
    """Above the upper quartile of the expected cost over claim rows (expected_p75, where the caller has it already)."""
    known = df if "expected_p75" in df.columns else df.join(F.broadcast(quantiles(df, F.col("expected_cost"), expected_p75=0.75)), how="cross")
    return known.withColumn("is_high_cost", F.coalesce((F.col("billed_amount_imputed") > F.col("expected_p75")).cast("int"), F.lit(0))).drop("expected_p75")


def build_features(base: DataFrame) -> DataFrame:
    """All features. Medians and quartile are taken from the base itself, not from what is joined to it, and meet its rows as one row."""
    known = impute_amounts(base, overall(base))
    out = known.join(provider_aggregates(base), "provider_id", "left").join(patient_counts(base), "patient_id", "left")
    return out.transform(encode).transform(log_amounts).transform(cap_deviations).transform(flag_high_cost)


def lookup_tables(features: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame) -> dict[str, DataFrame]:
    """What scoring new claims needs, as tables; each is keyed and as large as its key's domain."""
    history = provider_aggregates(features).join(providers.select("provider_id", "specialty", "location"), "provider_id", "left")
    return {
        "amount_medians": procedure_medians(features).select("procedure_code", F.bround("procedure_median", 6).alias("procedure_median")),
        "provider_history": history,
        "patient_counts": patient_counts(features),
        "diagnosis": diagnosis.transform(encode_severity),
        "regional_cost": regional_benchmark(cost),
        "procedure_cost": procedure_benchmark(cost),
        "scalars": overall(features).select("global_median", F.coalesce("expected_p75", F.lit(0.0)).alias("expected_cost_p75")),
    }


def encode_severity(diagnosis: DataFrame) -> DataFrame:
    return diagnosis.select("diagnosis_code", "category", "severity", encoded("severity", SEVERITY_RANK).alias("severity_rank"))


def run_report(features: DataFrame) -> DataFrame:
    """(metric, value) rows: claims, denied, denial rate %, claims by cost match."""
    n = F.count("*").cast("double")
    facts = features.agg(n.alias("rows"), F.sum("denial_flag").cast("double").alias("denied"), F.bround(F.avg("denial_flag") * 100, 1).alias("denial_rate_pct"), *(F.count_if(F.col("cost_match_level") == m).cast("double").alias(f"cost_match_{m}") for m in COST_MATCH))
    return facts.unpivot([], facts.columns, "metric", "value")
