"""Ranges of equal depth, and what is carried across their borders, with ranges of few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import joins, nulls, ordered, pieces


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(pieces, "ROWS", 50)


@pytest.fixture(scope="module")
def burst(spark):
    """99 % of the rows in one second of a month."""
    rng = np.random.default_rng(5)
    t = np.concatenate([1e6 + rng.uniform(0, 1, 4950), rng.uniform(0, 2.6e6, 50)])
    return spark.createDataFrame([("a" if i % 10 else "b", float(x), i, float(rng.normal())) for i, x in enumerate(t)], "g string, t double, id int, v double").cache()


def test_bursts_are_split(small, burst):
    held = pieces.ranged(burst, ["g"], "t").groupBy("g", pieces.CUT).agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("g", pieces.CUT).collect()
    for g, rows in (("a", 4500), ("b", 500)):
        own = [r for r in held if r.g == g]
        assert len(own) == rows // 50 and max(r.n for r in own) <= 100 and all(x.hi < y.lo for x, y in zip(own, own[1:]))


def test_ranges_without_keys_nulls_and_ties(small, spark):
    rows = [(float(i // 40),) for i in range(1000)] + [(None,)] * 30 + [(float("nan"),)] * 5
    found = pieces.ranged(spark.createDataFrame(rows, "t double"), [], "t").groupBy(pieces.CUT).agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()
    assert {r.n for r in found if r[pieces.CUT] is None} == {30} and max(r.n for r in found) <= 125
    assert sum(r.n for r in found) == 1035 and pieces.ranged(spark.createDataFrame([], "t double"), [], "t").count() == 0


def test_numbers_and_neighbours_over_bursts(small, burst):
    rows = sorted(burst.collect(), key=lambda r: (r.g, r.t))
    got = sorted(pieces.numbered(burst, ["g"], ["t", "id"]).collect(), key=lambda r: (r.g, r.i))
    assert [(r.g, r.id) for r in got] == [(r.g, r.id) for r in rows] and {r.n for r in got} == {4500, 500}
    steps = {r.id: r.difference for r in ordered.first_difference(burst, ["g"], ["t", "id"], "v").collect()}
    want = {b.id: (b.v - a.v if a.g == b.g else None) for a, b in zip(rows, rows[1:])}
    assert all(steps[i] == pytest.approx(x) if x is not None else steps[i] is None for i, x in want.items())


def test_asof_over_bursts_and_gaps(small, spark, burst):
    right = burst.where("g = 'b'").select("t", "id", "v").unionByName(burst.where("id = 10").select("t", (F.col("id") + 10_000).alias("id"), "v"))
    left = burst.where("g = 'a'").select("t", "id")
    found = {r.id: r.r_id for r in joins.asof_nearest(left, right, 5000.0, order="id").collect()}
    there = sorted((r.t, r.id) for r in right.collect())
    times = np.array([x for x, _ in there])
    for r in left.collect():
        gaps = np.abs(times - r.t)
        best = gaps.min()
        if best > 5000:
            assert found[r.id] is None
            continue
        near = [k for k, d in zip(there, gaps) if d == best]
        back = [k for k in near if k[0] <= r.t]
        assert found[r.id] == (max(back)[1] if back else min(near)[1])


def test_one_family_is_ranked_in_many_ranges(small, spark):
    rng = np.random.default_rng(6)
    null = np.round(rng.normal(size=3000), 2)
    targets = np.round(rng.normal(size=200), 2).tolist() + [9.0, -9.0, None]
    frame = lambda xs, f: spark.createDataFrame([(f, None if x is None else float(x)) for x in xs], "family string, statistic double")
    found = nulls.rank_pvalue(frame(targets, "a").unionByName(frame([0.0], "none")), frame(null, "a")).collect()
    assert len(found) == 204
    for r in found:
        want = None if r.family == "none" or r.statistic is None else (1 + (null >= r.statistic).sum()) / 3001
        assert r.p == (want if want is None else pytest.approx(want))
    for alpha in (0.05, 0.5, 1e-9):
        place = int(np.floor(alpha * 3001 - 1))
        got = nulls.critical_value(frame(null, "a"), alpha).first()
        assert got.n == 3000 and got.critical == (np.sort(null)[::-1][place] if place >= 0 else None)
    cut = pieces.ranged(frame(np.unique(null), "a"), ["family"], "statistic").select(pieces.CUT).distinct().count()
    assert cut > 5


@pytest.mark.parametrize("kept", [2, 32])
def test_separated_top_is_the_greedy_choice(spark, monkeypatch, kept):
    monkeypatch.setattr(ordered, "KEPT", kept)
    rng = np.random.default_rng(7)
    rows = []
    for g in range(8):
        n = 400
        xs = rng.uniform(0, 30, n) if g % 2 else np.round(rng.uniform(0, 30, n), 1)
        stats = {0: rng.normal(size=n), 1: xs / 10, 2: -np.abs(xs - 11), 3: np.round(rng.normal(size=n), 1)}[g // 2]  # slopes: neighbours shut out the best of a cell
        rows += [(g, float(a), float(b)) for a, b in zip(xs, stats)]
    rows += [(0, None, 9.0), (0, 1.0, None), (0, float("nan"), 9.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, x double, s double").repartition(4)
    for apart, k, tolerance in ((1.0, 7, 0.0), (3.0, 20, 1e-9), (0.0, 5, 0.0)):
        found: dict = {}
        for r in ordered.separated_top(df, "g", "x", "s", apart, k, [5.0], 0.25, tolerance).collect():
            found.setdefault(r.g, []).append((r.place, r.x, r.s))
        for g in [*range(8), None]:
            own = sorted(((-s, x) for h, x, s in rows if h == g and x is not None and s is not None and x == x and abs(x - 5.0) >= 0.25))
            picked: list = []
            for s, x in own:
                if len(picked) < k and all(abs(x - y) >= apart - tolerance for _, y in picked):
                    picked.append((s, x))
            assert sorted(found[g]) == [(i + 1, x, -s) for i, (s, x) in enumerate(picked)], (g, apart)
