"""Profiles and audits of tables: every figure of all columns in one or two aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantiles

#: Columns that carry provenance, not data.
META = ("ingestion_timestamp", "source_file", "silver_timestamp", "gold_timestamp", "_ordinal")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META]


def _rows(one_row: DataFrame, columns: list[str], facts: list[str]) -> DataFrame:
    """A one-row table of `column__fact` columns as one row a column."""
    each = [F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}__{f}`").alias(f) for f in facts)) for c in columns]
    return one_row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def null_profile(df: DataFrame, dataset: str) -> DataFrame:
    """dataset, column, null_count, null_pct, present_count."""
    columns = data_columns(df)
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"{c}__null_count") for c in columns))
    one = one.withColumns({f"{c}__present_count": F.col("n") - F.col(f"{c}__null_count") for c in columns} | {f"{c}__null_pct": F.bround(F.coalesce(F.try_divide(F.col(f"{c}__null_count") * 100.0, F.col("n").cast("double")), F.lit(0.0)).cast("double"), 2) for c in columns})
    return _rows(one, columns, ["null_count", "null_pct", "present_count"]).select(F.lit(dataset).alias("dataset"), "column", "null_count", "null_pct", "present_count")


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """One row: full-row duplicates and id duplicates (a null is a value)."""
    rows = df.groupBy(*data_columns(df)).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("full_row_duplicates"))
    ids = df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("id_duplicates"))
    return rows.join(ids, how="cross")


def cardinality_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, distinct_count: exact, or by HyperLogLog where exact counts cost too much."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    columns = data_columns(df)
    return _rows(df.agg(*(count(F.col(c)).alias(f"{c}__distinct_count") for c in columns)), columns, ["distinct_count"])


def numeric_profile(df: DataFrame) -> DataFrame:
    """column, count, mean, std, min, p25, p50, p75, max (2 decimals; sample deviation, exact quartiles)."""
    columns = [c for c, t in df.select(*data_columns(df)).dtypes if t in NUMERIC or t.startswith("decimal")]
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    facts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in facts.items()))
    whole = _rows(one, columns, list(facts)).join(quantiles(long, F.col("v"), ("column",), p25=0.25, p50=0.5, p75=0.75), "column", "left")
    order = ("mean", "std", "min", "p25", "p50", "p75", "max")
    return whole.select("column", "count", *(F.bround(c, 2).alias(c) for c in order))


def value_counts(df: DataFrame, most_distinct: int = 10, top: int = 10) -> DataFrame:
    """column, value, count of string columns with few distinct values; null is a value; the top of each."""
    columns = [c for c, t in df.select(*data_columns(df)).dtypes if t == "string"]
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))).alias("x")).groupBy("x.column", "x.value").count()
    w = Window.partitionBy("column")
    ranked = long.withColumn("distinct", F.count("value").over(w)).where(F.col("distinct") <= most_distinct)
    return ranked.withColumn("n", F.row_number().over(w.orderBy(F.desc("count"), F.col("value").asc_nulls_last()))).where(F.col("n") <= top).select("column", "value", "count")


def profile_all(tables: dict[str, DataFrame]) -> DataFrame:
    """dataset, column, null_count, null_pct, present_count, distinct_count of all data sets; a missing one (None) is skipped."""
    parts = [null_profile(df, name).join(cardinality_profile(df), "column") for name, df in tables.items() if df is not None]
    return reduce(DataFrame.unionByName, parts).select("dataset", "column", "null_count", "null_pct", "present_count", "distinct_count")


def audit(df: DataFrame) -> DataFrame:
    """column, dtype, null_pct, distinct_count, suggestion: which integers could be narrower, which strings have few values."""
    columns, types = data_columns(df), dict(df.dtypes)
    number = lambda c: types[c] in NUMERIC
    one = df.agg(F.count("*").alias("n"), *(f.alias(f"{c}__{n}") for c in columns for n, f in {"nulls": F.count_if(F.col(c).isNull()), "distinct_count": F.count_distinct(F.col(c)), "low": F.min(F.col(c)).cast("double") if number(c) else F.lit(None).cast("double"), "high": F.max(F.col(c)).cast("double") if number(c) else F.lit(None).cast("double")}.items()))
    long = _rows(one.withColumns({f"{c}__dtype": F.lit(types[c]) for c in columns} | {f"{c}__rows": F.col("n") for c in columns}), columns, ["dtype", "rows", "nulls", "distinct_count", "low", "high"])
    whole = F.col("dtype").isin("int", "bigint", "smallint")
    suggestion = (
        F.when(whole & (F.col("low") >= -128) & (F.col("high") <= 127), "tinyint").when(whole & (F.col("low") >= -32768) & (F.col("high") <= 32767), "smallint").when((F.col("dtype") == "bigint") & (F.col("low") >= -(2**31)) & (F.col("high") < 2**31), "int")
        .when((F.col("dtype") == "string") & F.col("distinct_count").between(1, 10) & (F.col("rows") > 100), "low cardinality").otherwise("")
    )
    return long.select("column", "dtype", F.bround(F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("rows").cast("double")), F.lit(0.0)).cast("double"), 2).alias("null_pct"), "distinct_count", suggestion.alias("suggestion"))
