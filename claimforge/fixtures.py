"""The claims data model over the test tables, and the layers built on it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gold, silver

CLAIMS = """select concat(cast(l.l_orderkey as varchar(20)),'-',cast(l.l_linenumber as varchar(20))) as claim_id,
 concat('P',cast(o.o_custkey as varchar(20))) as patient_id, concat('PR',cast(l.l_suppkey as varchar(20))) as provider_id,
 case when l.l_orderkey % 7 = 0 then null else concat(' d',cast(l.l_partkey % 12 as varchar(20)),' ') end as diagnosis_code,
 case when (l.l_orderkey + l.l_linenumber) % 11 = 0 then null else concat('proc',cast(l.l_partkey % 10 as varchar(20))) end as procedure_code,
 case when l.l_partkey % 13 = 0 then null when l.l_partkey % 97 = 0 then -l.l_extendedprice else l.l_extendedprice end as billed_amount,
 case when l.l_orderkey % 101 = 0 then 'not-a-date' else cast(cast(l.l_shipdate as date) as varchar(20)) end as date,
 case when l.l_returnflag = 'R' then 1 else 0 end as denial_flag
 from lineitem l join orders o on l.l_orderkey = o.o_orderkey"""
PROVIDERS = """select concat('PR',cast(s.s_suppkey as varchar(20))) as provider_id, s.s_name as doctor_name,
 case s.s_suppkey % 5 when 0 then 'neurology' when 1 then ' cardiology' when 2 then 'ORTHOPEDIC' when 3 then 'general' else 'dermatology' end as specialty,
 case when s.s_suppkey % 10 = 0 then null else lower(n.n_name) end as location
 from supplier s join nation n on s.s_nationkey = n.n_nationkey"""
DIAGNOSIS = """select distinct concat('d',cast(p_partkey % 12 as varchar(20))) as diagnosis_code,
 case p_partkey % 4 when 0 then 'heart' when 1 then 'bone' when 2 then 'fever' else 'skin' end as category,
 case p_partkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as severity from part where p_partkey % 12 <> 11"""
COST = """select concat('proc',cast(p.p_partkey % 10 as varchar(20))) as procedure_code, n.n_name as region,
 round(avg(p.p_retailprice),2) as average_cost, round(avg(p.p_retailprice) * 1.25,2) as expected_cost
 from part p join nation n on n.n_nationkey = p.p_partkey % 25 where p.p_partkey % 10 <> 9 group by p.p_partkey % 10, n.n_name"""


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Layers written in this session: (application, data folder, layer) -> path.
_written: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, a temporary one only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else f"file://{tempfile.mkdtemp(prefix='claims-')}/{name}"


@contextmanager
def removed_shuffles(spark: SparkSession):
    """Inside, what a query has shuffled is deleted at its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Claims:
    """Tables of one test data folder; layers are written once a session and read from there, as in a medallion pipeline."""

    def layer(self, name: str, df) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            path, frame = shared_folder(self.spark, name), df()
            with removed_shuffles(self.spark):
                frame.write.option("compression", "zstd").parquet(path)
            _written[key] = path
        return self.spark.read.parquet(_written[key])

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, sql: str, *names: str) -> DataFrame:
        for name in names:
            sql = sql.replace(f"from {name} ", f"from {{{name}}} ").replace(f"join {name} ", f"join {{{name}}} ")
        return self.spark.sql(sql, **{n: self.table(n) for n in names})

    @cached_property
    def claims_raw(self) -> DataFrame:
        return self.view(CLAIMS, "lineitem", "orders")

    @cached_property
    def providers_raw(self) -> DataFrame:
        return self.view(PROVIDERS, "supplier", "nation")

    @cached_property
    def diagnosis_raw(self) -> DataFrame:
        return self.view(DIAGNOSIS, "part")

    @cached_property
    def cost_raw(self) -> DataFrame:
        return self.view(COST, "part", "nation")

    @cached_property
    def claims(self) -> DataFrame:
        return self.layer("claims_silver", lambda: silver.clean_claims(self.claims_raw))

    @cached_property
    def providers(self) -> DataFrame:
        return silver.clean_providers(self.providers_raw)

    @cached_property
    def diagnosis(self) -> DataFrame:
        return silver.clean_diagnosis(self.diagnosis_raw)

    @cached_property
    def cost(self) -> DataFrame:
        return silver.clean_cost(self.cost_raw)

    @cached_property
    def base(self) -> DataFrame:
        return self.layer("gold_base", lambda: gold.resolve_label(gold.build_base(self.claims, self.providers, self.diagnosis, self.cost)))

    @cached_property
    def features(self) -> DataFrame:
        return self.layer("gold_features", lambda: gold.build_features(self.base))

    @cached_property
    def scored(self) -> DataFrame:
        """Every line item with a label and a fixed score in [0, 1]."""
        line = self.table("lineitem")
        return line.select(
            F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("row_id"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"),
            F.round((F.col("l_discount").cast("double") * 5 + F.col("l_tax").cast("double") * 4 + (F.col("l_quantity").cast("double") % 10) / 50) / 1.02, 3).alias("score"),
        ).withColumn("score", F.least(F.lit(1.0), "score"))
