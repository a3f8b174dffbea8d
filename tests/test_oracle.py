"""Every registered claims query against its SQL twin in DuckDB, on the smallest tables."""

import math
import os
from decimal import Decimal
from glob import glob

import duckdb
import pytest

from claimforge.plans import registry


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 6) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(name, spark, small, duck):
    df = registry.QUERIES[name](spark, small)
    found = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(name, spark, small):
    assert registry.QUERIES[name](spark, small).count() > 0
