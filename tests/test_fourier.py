"""Transforms over many tasks, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import fourier, nulls, pieces, series


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(fourier, "SMALL", 20)
    monkeypatch.setattr(fourier, "LIMIT", 70)
    monkeypatch.setattr(pieces, "ROWS", 64)


def frame(spark, groups):
    rows = [(g, len(x), i, float(v.real), float(v.imag)) for g, x in groups.items() for i, v in enumerate(x) if v != 0]
    return spark.createDataFrame(rows, "g string, n long, i long, re double, im double").repartition(16)


def test_all_lengths_are_numpys_transforms(small, spark):
    rng = np.random.default_rng(4)
    groups = {f"s{n}": rng.normal(size=n) + 1j * rng.normal(size=n) for n in (1, 2, 17, 24, 1024, 900, 101, 331, 142)}  # columns and rows, primes, a divisor too small
    groups["sparse"] = np.where(rng.uniform(size=480) < 0.1, groups["s1024"][:480], 0)
    df = frame(spark, groups)
    for inverse, plain in ((False, np.fft.fft), (True, np.fft.ifft)):
        found: dict = {}
        for r in fourier.transform(df, ["g"], inverse).collect():
            found.setdefault(r.g, {})[r.i] = complex(r.re, r.im)
        assert set(found) == set(groups)
        for g, x in groups.items():
            assert sorted(found[g]) == list(range(len(x))) and np.allclose([found[g][k] for k in range(len(x))], plain(x), atol=1e-9), g


@pytest.mark.parametrize("n", [1024, 331])
def test_no_group_has_a_long_series(small, spark, n):
    """Columns and rows of a table, not the series, are what tasks get."""
    plan = fourier.transform(frame(spark, {"a": np.ones(n)}), ["g"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("FlatMapGroupsInPandas") >= 3  # no series is short: columns, rows, and an empty rest
    assert plan.where("i = 0").first().re == pytest.approx(n) and plan.where("i > 0").agg(F.max(F.abs("re") + F.abs("im"))).first()[0] < 1e-8
    assert n > fourier.LIMIT


def test_periodogram_of_a_series_in_sixteen_ranges(small, spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=1024))
    rows = [("a", float(3 * i), float(v)) for i, v in enumerate(x)] + [("a", 1.5, None), ("few", 1.0, 2.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, t double, v double").repartition(16)
    assert pieces.ranged(df.where("g = 'a'"), ["g"], "t").select(pieces.CUT).distinct().count() >= 16
    found = sorted((r.frequency, r.density) for r in series.periodogram(df, "g", "t", "v", 0.5).collect())
    i = np.arange(1024)
    p = np.abs(np.fft.rfft(x - np.polyval(np.polyfit(i, x, 1), i))) ** 2 / 1024 * 0.5
    p[1:-1] *= 2
    assert np.allclose([f for f, _ in found], np.fft.rfftfreq(1024, 0.5)) and np.allclose([d for _, d in found], p, rtol=1e-8, atol=1e-9)


@pytest.mark.parametrize("n", [16, 331, 360])
def test_rotations_are_all_sums(small, spark, n):
    rng = np.random.default_rng(6)
    a, b, y = rng.normal(size=(3, n))
    df = spark.createDataFrame([("g", 7, i, *map(float, v)) for i, v in enumerate(zip(a, b, y))], "k string, f int, place long, a double, b double, y double").repartition(5)
    found = sorted(nulls.rotations(df, ["k", "f"], "place", ["a", "b"], "y").collect(), key=lambda r: r["shift"])
    assert [r["shift"] for r in found] == list(range(n)) and all((r.k, r.f) == ("g", 7) for r in found)
    want = [[x @ np.roll(y, -s) for x in (a, b)] for s in range(n)]
    assert np.allclose([(r.a, r.b) for r in found], want, atol=1e-9)
