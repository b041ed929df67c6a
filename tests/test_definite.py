"""Matrices in blocks, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import definite, lens


def cells(spark, m, names=None):
    names = names if names is not None else range(len(m))
    return spark.createDataFrame([(int(a), int(b), float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "i int, j int, v double").repartition(4)


@pytest.mark.parametrize("size", [1, 16, 41])
def test_blocks_give_numpys_eigenvalues(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(size, 2 * size + 3))
    names = np.sort(rng.choice(1000, size, replace=False))
    m = x @ x.T
    want = np.linalg.eigvalsh(m)
    good, low, condition = definite.judge(cells(spark, m, names), size, 16)
    assert good and low == pytest.approx(want[0], rel=1e-6) and condition == pytest.approx(want[-1] / want[0], rel=1e-6)
    if size > 16:
        bad = m - np.eye(size) * (want[0] + 0.01 * want[-1])  # definite up to its least eigenvalue
        good, low, condition = definite.judge(cells(spark, bad, names), size, 16)
        assert not good and low == pytest.approx(-0.01 * want[-1], rel=1e-5) and condition is None


def test_missing_doubled_and_odd_cells_have_no_judgement(spark):
    c = cells(spark, np.eye(20))
    for odd in (c.where("i <> 17 OR j <> 3"), c.union(c.where("i = 18 AND j = 18")), c.withColumn("v", F.when(F.expr("i = 19 AND j = 2"), F.lit(float("nan"))).otherwise(F.col("v"))), c.withColumn("v", F.expr("IF(i = 5 AND j = 5, NULL, v)"))):
        assert definite.judge(odd, 20, 16) == (None, None, None)


def test_five_thousand_rows(spark):
    """A diagonal from 1 to 2 with one value below and one above it, and correlations that fall off beside it."""
    n = 5000
    d = 1 + np.arange(n) / n
    d[1234], d[4321] = 0.25, 8.0
    m = np.diag(d)
    for k in range(1, 30):
        m += 0.01 * (np.diag(np.full(n - k, 0.5**k), k) + np.diag(np.full(n - k, 0.5**k), -k))
    at = F.when(F.col("i") == 1234, 0.25).when(F.col("i") == 4321, 8.0).otherwise(1 + F.col("i") / n)
    away = F.abs(F.col("i") - F.col("j"))
    c = spark.range(0, n * n, 1, 8).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    c = c.withColumn("v", F.when(away == 0, at).when(away < 30, 0.01 * F.pow(F.lit(0.5), away)).otherwise(0.0))
    good, low, condition = definite.judge(c, n)
    v = np.zeros(n)  # inverse iteration beside the least value
    v[1234] = 1.0
    for _ in range(4):
        v = np.linalg.solve(m - 0.2 * np.eye(n), v)
        v /= np.linalg.norm(v)
    w = np.zeros(n)
    w[4321] = 1.0
    for _ in range(60):
        w = m @ w
        w /= np.linalg.norm(w)
    assert good and low == pytest.approx(v @ m @ v, rel=1e-6) and condition == pytest.approx((w @ m @ w) / (v @ m @ v), rel=1e-6)


def test_checks_pass_to_blocks_above_their_bound(spark, monkeypatch):
    monkeypatch.setattr(lens, "ONE_TASK", 10)
    x = np.random.default_rng(5).normal(size=(12, 40))
    m = x @ x.T
    want = np.linalg.eigvalsh(m)
    r = lens.covariance_checks(cells(spark, m)).first()
    assert (r.size, r.missing, r.asymmetric, r.positive_definite) == (12, 0, 0, True)
    assert r.least_eigenvalue == pytest.approx(want[0], rel=1e-6) and r.condition == pytest.approx(want[-1] / want[0], rel=1e-6)
    m[3, 4] += 1
    r = lens.covariance_checks(cells(spark, m)).first()
    assert (r.asymmetric, r.positive_definite, r.condition) == (2, None, None)
