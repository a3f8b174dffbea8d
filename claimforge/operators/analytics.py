"""Summary analytics over bronze and silver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantiles
from ..functions.text import ratio, safe_number
from .silver import safe_date

CRITICAL = ("diagnosis_code", "procedure_code", "billed_amount")
FLAGS = ("diagnosis_code_missing", "procedure_code_missing", "billed_amount_missing", "proc_no_diag", "diag_no_proc")
#: Violations in their order of listing.
VIOLATIONS = (("proc_no_diag", "Procedure w/o Diagnosis", "High"), ("diag_no_proc", "Diagnosis w/o Procedure", "Medium"), ("billed_amount_missing", "Amount Missing", "Medium"), ("diagnosis_code_missing", "Diagnosis Missing", "High"), ("procedure_code_missing", "Procedure Missing", "Medium"))
LEVELS = ("Complete (0 missing)", "1 field missing", "2 fields missing", "Shell (all 3 missing)")

AMOUNT = lambda: safe_number(F.col("billed_amount"))
mean = lambda: F.bround(F.avg(AMOUNT()), 2)
total = lambda: F.bround(F.coalesce(F.sum(AMOUNT().cast("decimal(18,2)")), F.lit(0)).cast("double"), 2)
count = lambda: F.count("claim_id")
percent = lambda part, whole, digits: F.bround(F.coalesce(F.try_divide(part * 100.0, whole.cast("double")), F.lit(0.0)).cast("double"), digits)


def overview(claims: DataFrame) -> DataFrame:
    present = [F.col(c).isNotNull() for c in CRITICAL]
    d = safe_date(F.col("date"))
    return claims.agg(
        F.count("*").alias("total_claims"), F.count_distinct("patient_id").alias("unique_patients"), F.count_distinct("provider_id").alias("unique_providers"),
        F.coalesce(F.min(d).cast("string"), F.lit("N/A")).alias("date_min"), F.coalesce(F.max(d).cast("string"), F.lit("N/A")).alias("date_max"),
        F.coalesce(mean(), F.lit(0.0)).alias("avg_billed_amount"), total().alias("total_billed"),
        F.count_if(present[0] & present[1] & present[2]).alias("claims_complete"), F.count_if(~(present[0] | present[1] | present[2])).alias("shell_claims"),
    )


def by_provider(claims: DataFrame, providers: DataFrame) -> DataFrame:
    out = claims.groupBy("provider_id").agg(count().alias("claim_count"), mean().alias("avg_billed"), total().alias("total_billed"))
    return out.join(providers.select("provider_id", "specialty", "location"), "provider_id", "left").orderBy(F.desc("claim_count"), "provider_id")


def by_diagnosis(claims: DataFrame, diagnosis: DataFrame) -> DataFrame:
    out = claims.groupBy("diagnosis_code").agg(count().alias("claim_count"), mean().alias("avg_billed"))
    return out.join(diagnosis, "diagnosis_code", "left").orderBy(F.desc("claim_count"), "diagnosis_code")


def by_specialty(claims: DataFrame, providers: DataFrame) -> DataFrame:
    joined = claims.join(providers.select("provider_id", "specialty"), "provider_id", "left")
    return joined.groupBy("specialty").agg(count().alias("claim_count"), mean().alias("avg_billed"), total().alias("total_billed")).orderBy(F.desc("claim_count"), "specialty")


def timeline(claims: DataFrame) -> DataFrame:
    d = claims.withColumn("d", safe_date(F.col("date"))).where("d is not null")
    return d.groupBy(F.date_format("d", "yyyy-MM-dd").alias("date_str")).agg(count().alias("claim_count")).orderBy("date_str")


def cost_analysis(claims: DataFrame, cost: DataFrame) -> DataFrame:
    """Per procedure against each of its benchmark rows: more than one a procedure is meant."""
    spent = claims.where(AMOUNT().isNotNull()).groupBy("procedure_code").agg(count().alias("claim_count"), F.avg(AMOUNT()).alias("mean"), F.bround(F.min(AMOUNT()), 2).alias("min_billed"), F.bround(F.max(AMOUNT()), 2).alias("max_billed"))
    out = spent.join(cost.select("procedure_code", "region", "expected_cost"), "procedure_code", "left")
    return out.select("procedure_code", "region", "expected_cost", "claim_count", F.bround("mean", 2).alias("avg_billed"), "min_billed", "max_billed", ratio(F.col("mean") - F.col("expected_cost"), F.col("expected_cost"), 2, 100).alias("deviation_pct"))


def high_cost(claims: DataFrame, cost: DataFrame, threshold: float = 100.0, top: int = 20) -> DataFrame:
    """Claims whose amount is over a benchmark row by more than a percentage; the top ones (a report)."""
    joined = claims.where("billed_amount is not null").join(cost.select("procedure_code", "region", "expected_cost"), "procedure_code")
    out = joined.select("claim_id", "procedure_code", "region", "billed_amount", "expected_cost", ratio(F.col("billed_amount") - F.col("expected_cost"), F.col("expected_cost"), 2, 100).alias("deviation_pct"))
    return out.where(F.col("deviation_pct") > threshold).orderBy(F.desc("deviation_pct"), "claim_id", "region").limit(top)


def above_benchmark(base: DataFrame, top: int = 20) -> DataFrame:
    """Claims above their tiered benchmark, the top ones by deviation."""
    return base.where("billed_deviation_pct > 0").orderBy(F.desc("billed_deviation_pct"), "claim_id").limit(top).select("claim_id", "procedure_code", "location", "billed_amount", "expected_cost", "cost_match_level", "billed_deviation_pct")


def cleaning_impact(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    names = {"diag": "diagnosis_code", "proc": "procedure_code", "amount": "billed_amount"}
    n = F.count("*")
    nulls = lambda side: [percent(F.count_if(F.col(c).isNull()), n, 2).alias(f"{side}_{k}_null_pct") for k, c in names.items()]
    b = bronze.agg(n.alias("bronze_rows"), *nulls("bronze"))
    flags = {"flagged_diag": FLAGS[0], "flagged_proc": FLAGS[1], "flagged_amount": FLAGS[2], "proc_no_diag": FLAGS[3], "diag_no_proc": FLAGS[4]}
    s = silver.agg(n.alias("silver_rows"), *nulls("silver"), *(F.count_if(F.col(c)).alias(k) for k, c in flags.items()), percent(F.count("date"), n, 2).alias("date_parsed_pct"))
    return b.join(s, how="cross").withColumn("rows_removed", F.col("bronze_rows") - F.col("silver_rows"))


def completeness(silver: DataFrame) -> DataFrame:
    """Buckets of 0 to 3 missing fields with their share; empty ones too."""
    missing = sum((F.col(c).cast("int") for c in FLAGS[1:3]), F.col(FLAGS[0]).cast("int"))
    one = silver.withColumn("m", missing).agg(F.count("*").alias("n"), *(F.count_if(F.col("m") == i).alias(f"_{i}") for i in range(4)))
    rows = F.array(*(F.struct(F.lit(label).alias("completeness_level"), F.lit(i).alias("missing_count"), F.col(f"_{i}").alias("claim_count")) for i, label in enumerate(LEVELS)))
    return one.select("n", F.explode(rows).alias("x")).select("x.*", percent(F.col("x.claim_count"), F.col("n"), 1).alias("pct"))


def violations(silver: DataFrame) -> DataFrame:
    one = silver.agg(F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(c) for c, _, _ in VIOLATIONS))
    rows = F.array(*(F.struct(F.lit(label).alias("violation"), F.lit(severity).alias("severity"), F.col(c).alias("claim_count")) for c, label, severity in VIOLATIONS))
    return one.select("n", F.explode(rows).alias("x")).select("x.*", percent(F.col("x.claim_count"), F.col("n"), 1).alias("pct_of_claims")).orderBy(F.desc("claim_count"), "violation")


def provider_risk(silver: DataFrame, providers: DataFrame) -> DataFrame:
    out = silver.where("provider_id is not null").groupBy("provider_id").agg(count().alias("total_claims"), mean().alias("avg_billed"), *(F.count_if(F.col(c)).alias(c) for c in FLAGS))
    out = out.withColumn("total_violations", sum((F.col(c) for c in FLAGS[1:]), F.col(FLAGS[0])))
    out = out.withColumn("violation_rate_pct", percent(F.col("total_violations"), F.col("total_claims"), 1))
    return out.join(providers.select("provider_id", "specialty", "location"), "provider_id", "left").orderBy(F.desc("violation_rate_pct"), "provider_id")


def histogram(df: DataFrame, column: str, bins: int, low=None, high=None) -> DataFrame:
    """bin, count of equal-width bins (the last one closed); edges from one row of minimum and maximum; all bins listed."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    edge = values.agg(F.min("x").alias("a"), F.max("x").alias("b")) if low is None else df.sparkSession.range(1).select(F.lit(float(low)).alias("a"), F.lit(float(high)).alias("b"))
    edge = edge.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins).cast("int"))
    found = values.join(F.broadcast(edge), how="cross").groupBy(place.alias("bin")).count()
    spine = edge.where("a is not null").select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(found, "bin", "left").select("bin", (F.col("a") + F.col("bin") * (F.col("b") - F.col("a")) / bins).alias("bin_start"), (F.col("a") + (F.col("bin") + 1) * (F.col("b") - F.col("a")) / bins).alias("bin_end"), F.coalesce("count", F.lit(0)).alias("n"))


def billed_distribution(silver: DataFrame, bins: int = 12) -> DataFrame:
    h = histogram(silver, "billed_amount", bins)
    k = lambda c: F.bround(F.col(c) / 1000, 0).cast("long").cast("string")
    return h.select("bin", F.concat(k("bin_start"), F.lit("k-"), k("bin_end"), F.lit("k")).alias("bin_label"), F.bround("bin_start", 2).alias("bin_start"), F.col("n").alias("claim_count"))


def outcomes(claims: DataFrame) -> DataFrame:
    """outcome, claims, denial_rate_pct (of all claims): approved, denied and unknown."""
    outcome = F.when(F.col("denial_flag") == 1, "denied").when(F.col("denial_flag") == 0, "approved").otherwise("unknown")
    rate = claims.agg(F.bround(F.avg("denial_flag") * 100, 2).alias("denial_rate_pct"))
    return claims.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("claims")).join(F.broadcast(rate), how="cross")


def dimension_counts(base: DataFrame, dimensions: tuple[str, ...] = ("specialty", "location", "severity", "cost_match_level")) -> DataFrame:
    """dimension, value, claims of several dimensions in one pass (a row for each dimension); null is Unknown."""
    long = base.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("Unknown")).alias("value")) for d in dimensions))).alias("x"))
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("claims"))


def top_specialties(base: DataFrame, top: int = 6) -> DataFrame:
    return dimension_counts(base, ("specialty",)).orderBy(F.desc("claims"), "value").limit(top).select("value", "claims")


def amount_snapshot(claims: DataFrame) -> DataFrame:
    p = quantiles(claims, AMOUNT(), median_billed=0.5, p90_billed=0.9)
    return p.select(*(F.bround(c, 2).alias(c) for c in p.columns))


def benchmark_spread(claims: DataFrame, cost: DataFrame, over: float = 50.0) -> DataFrame:
    worst = cost_analysis(claims, cost).where("deviation_pct is not null").groupBy("procedure_code").agg(F.max("deviation_pct").alias("d"))
    return worst.agg(F.bround(F.median("d"), 2).alias("median_deviation_pct"), F.count_if(F.col("d") > over).alias("procedures_over"))


def flag_arithmetic(silver: DataFrame, providers: DataFrame) -> DataFrame:
    """tier, providers, shell_claims, amount_without_codes: provider tiers by violation rate beside claim flag counts."""
    tier = F.when(F.col("violation_rate_pct") > 50, "red").when(F.col("violation_rate_pct") > 25, "amber").otherwise("green")
    tiers = provider_risk(silver, providers).groupBy(tier.alias("tier")).agg(F.count("*").alias("providers"))
    d, p, a = (F.col(c) for c in FLAGS[:3])
    facts = silver.agg(F.count_if(d & p & a).alias("shell_claims"), F.count_if(~a & d & p).alias("amount_without_codes"))
    return tiers.join(F.broadcast(facts), how="cross")


