"""Sums with waves of whole families, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import fringe, waves


def direct(t, x, q, f):
    z = np.exp(2j * np.pi * np.multiply.outer(t, f))
    xz = x.T @ z
    return xz.real, xz.imag, q @ z.real**2, q @ (z.real * z.imag), q @ z.imag**2


@pytest.mark.parametrize("family", [np.arange(1, 701) * 0.003, np.sort(np.random.default_rng(0).uniform(0.01, 2, 300)), np.array([0.25])])
def test_sums_of_a_family_are_the_direct_ones(spark, monkeypatch, family):
    monkeypatch.setattr(waves, "BATCH", 64)
    rng = np.random.default_rng(1)
    n = 400
    g, t, y, w, m = rng.integers(0, 3, n), rng.uniform(0, 5e4, n), rng.normal(size=n), rng.uniform(0.5, 2, n), rng.normal(size=n)
    rows = [(int(a), *map(float, b)) for a, *b in zip(g, t, y, w, m)] + [(None, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0), (1, 2.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, t double, y double, w double, m double").repartition(4)
    found = waves.wave_sums(df, ["g"], F.col("t"), [F.col("y"), F.lit(1.0)], family.tolist(), F.col("w"), F.col("m")).collect()
    assert len(found) == 3 * len(family)
    for k in range(3):
        own = g == k
        c, s, cc, cs, ss = direct(t[own], (np.stack([y, np.ones(n)], 1) * (w * m)[:, None])[own], (w * m * m)[own], family)
        rows = sorted((r for r in found if r.g == k), key=lambda r: r.frequency)
        for i in range(2):
            assert np.allclose([r[f"c{i}"] for r in rows], c[i], atol=1e-8) and np.allclose([r[f"s{i}"] for r in rows], s[i], atol=1e-8)
        assert np.allclose([(r["cc"], r["cs"], r["ss"]) for r in rows], np.stack([cc, cs, ss], 1), atol=1e-8)


def test_many_groups_are_sent_on_early(spark, monkeypatch):
    monkeypatch.setattr(waves, "HELD", 1)
    df = spark.range(60).select((F.col("id") % 7).alias("frequency"), F.col("id").cast("double").alias("t"))  # a key named like a result
    found = waves.wave_sums(df.withColumnRenamed("frequency", "x0"), ["x0"], F.col("t"), [F.lit(1.0)], [0.0, 0.5]).collect()
    assert len(found) == 14 and all(r.ss == 0 and r.cs == 0 for r in found)  # whole and half turns have no sine
    assert sum(r.cc for r in found) == 120


def test_profiled_scores_of_a_wide_family(spark):
    rng = np.random.default_rng(2)
    n, family = 500, (np.arange(1, 2001) * 0.0005).tolist()
    g, t, y, m, sigma = rng.integers(0, 2, n), rng.uniform(0, 900, n), rng.normal(size=n), rng.normal(size=n), rng.uniform(0.5, 2, n)
    u = t / 900
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, *b in zip(g, t, y, m, sigma, u)], "g int, t double, y double, m double, sigma double, u double").withColumn("one", F.lit(1.0))
    found = sorted(fringe.profiled_scores(df, "g", "t", "y", ["one", "u"], family, F.col("m"), F.col("sigma")).collect(), key=lambda r: r.frequency)
    assert len(found) == 2000
    for k in range(0, 2000, 97):
        score, gram = np.zeros(2), np.zeros((2, 2))
        for own in (g == 0, g == 1):
            w = 1 / sigma[own] ** 2
            z = m[own, None] * np.stack([np.cos(2 * np.pi * family[k] * t[own]), np.sin(2 * np.pi * family[k] * t[own])], 1)
            x = np.stack([np.ones(own.sum()), u[own]], 1)
            off = lambda v: v - x @ np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w[:, None] * v))
            score += (off(z) * w[:, None]).T @ y[own]
            gram += (off(z) * w[:, None]).T @ off(z)
        q = np.linalg.solve(gram, score)
        assert (found[k].q_cos, found[k].q_sin, found[k].statistic) == pytest.approx((*q, score @ q), rel=1e-9, abs=1e-9)
