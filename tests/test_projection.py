"""Principal components against a singular value decomposition of all rows at once."""

import numpy as np
import pytest

from claimforge.operators import projection


def rows_of(n, d, seed):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, d)) @ np.diag(np.linspace(5, 1, d)) @ np.linalg.qr(r.normal(size=(d, d)))[0] + 3


@pytest.mark.parametrize("k", [1, 2, 5])
def test_projection_as_the_whole_matrix_has_it(spark, k):
    x = rows_of(300, 6, k)
    odd = [(1000, None), (1001, [1.0, 2.0]), (1002, [])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>").repartition(7)
    n, mean, c = projection.covariance(df)
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(c, np.cov(x.T))
    got = {r.vec_id: r.p for r in projection.projected(df, k=k).collect()}
    _, s, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ axes[:k].T
    found = np.array([got[i] for i in range(300)])
    assert len(got) == 300 and np.allclose(np.abs(found), np.abs(want), atol=1e-6)
    values, fixed = projection.components(c, k)
    assert np.allclose(values, s[:k] ** 2 / 299) and all(a[np.abs(a).argmax()] > 0 for a in fixed)
    again = {r.vec_id: r.p for r in projection.projected(df.repartition(2), k=k).collect()}
    assert all(np.allclose(again[i], got[i], atol=1e-9) for i in got)


def test_nulls_count_as_zero_and_few_rows_give_none(spark):
    df = spark.createDataFrame([(1, [1.0, None, float("nan")]), (2, [0.0, 2.0, float("inf")]), (3, [4.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert np.allclose(projection.covariance(df)[2], np.cov(np.array([[1, 0, 0], [0, 2, 0], [4, 1, 1.0]]).T))
    assert projection.projected(df).count() == 3 and projection.projected(df.limit(1)).count() == 0 and projection.projected(df.limit(0)).count() == 0
    assert projection.projected(df, k=4).count() == 0
