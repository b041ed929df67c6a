"""Scrambled Sobol points and shrinkage of long vectors, against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import network, points, shadow


def coordinates(df, names):
    return np.array([[r[n] for n in names] for r in df.orderBy("id").collect()])


def test_first_points_of_the_plain_sequence(spark):
    got = coordinates(points.sobol(spark.range(8), "id", ["a", "b", "c"]), "abc")
    want = [[0, 0, 0], [0.5, 0.5, 0.5], [0.75, 0.25, 0.25], [0.25, 0.75, 0.75], [0.375, 0.375, 0.625], [0.875, 0.875, 0.125], [0.625, 0.125, 0.875], [0.125, 0.625, 0.375]]
    assert got.tolist() == want


@pytest.mark.parametrize("seed", [None, 7, 8])
def test_every_dyadic_range_has_its_count(spark, seed):
    names = list("abcdefg")
    x = coordinates(points.sobol(spark.range(1024), "id", names, seed), names)
    assert x.min() >= 0 and x.max() < 1
    for i in range(7):  # one point in each of 1,024 ranges
        assert np.array_equal(np.sort((x[:, i] * 1024).astype(int)), np.arange(1024))
    for k in range(11):  # boxes of the first two dimensions, a net of quality 0
        boxes = (x[:, 0] * 2**k).astype(int) * 2 ** (10 - k) + (x[:, 1] * 2 ** (10 - k)).astype(int)
        assert len(set(boxes)) == 1024
    # the first three have quality 1 or better: two points in each box of a 512th
    for i, j in itertools.product(range(10), repeat=2):
        if i + j <= 9:
            boxes = np.ravel_multi_index(((x[:, 0] * 2**i).astype(int), (x[:, 1] * 2**j).astype(int), (x[:, 2] * 2 ** (9 - i - j)).astype(int)), (2**i, 2**j, 2 ** (9 - i - j)))
            assert (np.bincount(boxes, minlength=512) == 2).all()


def test_a_seed_gives_one_bank_whatever_the_partitions(spark):
    x, y = (coordinates(points.sobol(spark.range(0, 500, 1, n), "id", ["a", "b"], 3), "ab") for n in (1, 7))
    assert np.array_equal(x, y) and not np.array_equal(x, coordinates(points.sobol(spark.range(500), "id", ["a", "b"], 4), "ab"))
    odd = points.sobol(spark.createDataFrame([(-1,), (None,), (1 << 30,)], "id long"), "id", ["a"], 3)
    assert [r.a for r in odd.collect()] == [None] * 3
    with pytest.raises(ValueError):
        points.directions(8)
    bank = np.array([r[1:] for r in network.sobol_bank(spark, 256, 50.0, 800.0, 9).orderBy("template").collect()])
    speed = np.linalg.norm(bank, axis=1)
    assert speed.min() >= 50 - 1e-9 and speed.max() <= 800 and abs(np.log(speed).mean() - np.log(200)) < 0.02
    assert np.abs((bank / speed[:, None]).mean(0)).max() < 0.02
    short = network.sobol_bank(spark, 5, 50.0, 800.0, 9).orderBy("template").collect()
    assert np.array_equal(bank[:5], np.array([r[1:] for r in short]))


def test_spans_of_delays(spark):
    place = np.random.default_rng(1).normal(size=(40, 3))
    bank = network.sobol_bank(spark, 16, 1.0, 3.0, 2)
    v = np.array([r[1:] for r in bank.orderBy("template").collect()])
    d = (place - place.mean(0)) @ v.T / (v * v).sum(1)
    nodes = spark.createDataFrame([*map(tuple, place.tolist()), (None, 1.0, 1.0)], "x double, y double, z double")
    got = np.array([r[1:] for r in network.delay_spans(nodes, bank).orderBy("template").collect()])
    assert np.allclose(got, np.stack([np.full(16, 40), d.min(0), d.max(0), np.sqrt((d * d).mean(0))], 1))
    assert network.delay_spans(nodes.where("x > 1e9"), bank).count() == 0


def plain(x):
    n, p = x.shape
    c = x - x.mean(0)
    emp = c.T @ c / n
    mu = np.trace(emp) / p
    d2 = ((emp - mu * np.eye(p)) ** 2).sum() / p
    b2 = min((((c * c).sum(1) ** 2).mean() - (emp**2).sum()) / p / n, d2)
    return (1 - b2 / d2) * emp + b2 / d2 * mu * np.eye(p), b2 / d2


@pytest.mark.parametrize("size, held", [(3, 1 << 24), (150, 1 << 24), (200, 1 << 14)])
def test_long_vectors_shrink_in_strips(spark, monkeypatch, size, held):
    monkeypatch.setattr(shadow, "HELD", held)  # the last: two and more strips
    x = np.random.default_rng(size).normal(size=(300, size)) * np.linspace(1, 2, size) + 5
    odd = [[1.0] * (size - 1), [*[1.0] * (size - 1), None], [*[1.0] * (size - 1), float("nan")], [*[1.0] * (size - 1), float("inf")], None]
    df = spark.createDataFrame([(r,) for r in [*x.tolist(), *odd]], "e array<double>").repartition(5)
    got = shadow.shrink_vectors(df, "e", size).toPandas()
    want, shrinkage = plain(x)
    m = np.full((size, size), np.nan)
    m[got.i, got.j] = got.v
    assert len(got) == size * size and np.allclose(m, want, rtol=1e-10, atol=1e-12) and got.shrinkage[0] == pytest.approx(shrinkage, rel=1e-10)
    assert shadow.shrink_vectors(df.where(F.lit(False)), "e", size).count() == 0


def test_power_counts_what_is_detected_and_found_in_time(spark):
    trials = spark.createDataFrame([(t, a, 10.0 * t) for a, ts in ((1.0, range(0, 10)), (9.0, range(10, 110))) for t in ts], "trial int, amplitude double, centre double")
    # amplitude 1: one is only detected, one only found, one both, one has no hit; amplitude 9: all but five are both
    seen = {0: (9.0, 99.0), 1: (0.5, 11.0), 2: (9.0, 19.0)} | {t: (0.5, 0.0) for t in range(3, 9)} | {t: (9.0, 10.0 * t if t >= 15 else -5.0) for t in range(10, 110)}
    hits = spark.createDataFrame([(t, *v) for t, v in seen.items()], "trial int, statistic double, centre double")
    background = spark.createDataFrame([(float(x),) for x in range(20)], "statistic double").where("statistic < 9").unionByName(spark.range(11).selectExpr("0D AS statistic"))
    got = {r.amplitude: r for r in network.power(hits, trials, background, 0.05, 1.0).collect()}
    assert tuple(got[1.0])[1:5] == (10, 2, 2, 1) and tuple(got[9.0])[1:5] == (100, 100, 95, 95)
    assert got[9.0].rate == 0.95 and got[9.0].lower == pytest.approx(0.8882, abs=1e-4) and got[1.0].gate and got[9.0].gate
    assert not network.power(hits.where("trial < 80"), trials, background, 0.05, 1.0).first().gate
    assert {r.detected for r in network.power(hits, trials, background.where("statistic < 0"), 0.05, 1.0).collect()} == {0}


def test_hits_of_trials_in_their_own_segments(spark):
    rng = np.random.default_rng(4)
    values = spark.createDataFrame([(n, k, float(rng.normal())) for n in "ab" for k in range(60)], "node string, k long, z double")
    delays = spark.createDataFrame([(n, t, d) for t, (x, y) in enumerate([(0.3, -0.3), (1.5, -1.5)]) for n, d in (("a", x), ("b", y))], "node string, template int, delay double")
    weights = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "node string, w double")
    planted = [(t, n, 10.0 * t + 5, a) for t, a in enumerate((0.0, 0.5, 4.0, 40.0, 1.0, 2.0)) for n in "ab"]
    trials = spark.createDataFrame([(t, n, at, a, t) for t, n, at, a in planted], "trial int, node string, arrival double, amplitude double, segment long")
    part = lambda c: F.floor(c / 10)
    got = {r.trial: r for r in network.injected_hits(values, delays, weights, trials, segment=part).collect()}
    for t in range(6):
        struck = spark.createDataFrame([(n, int(at), a) for k, n, at, a in planted if k == t], "node string, k long, a double")
        loud = values.join(struck, ["node", "k"], "left").select("node", "k", (F.col("z") + F.coalesce("a", F.lit(0.0))).alias("z"))
        want = network.best_hit(network.surface(loud, delays, weights).where(part(F.col("centre")) == t)).first()
        assert (round(got[t].statistic, 9), got[t].centre, got[t].template) == (round(want.statistic, 9), want.centre, want.template)
