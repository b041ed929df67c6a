"""Every query beside its SQL on the smallest tables, and kernels against values worked out by hand."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import custody, joins, ordered, pieces, robust, series
from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    return "nan" if isinstance(x, float) and x != x else format(x, ".8g") if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_asof_ties_go_back_and_the_tolerance_is_inclusive(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 30.0), (3, None)], "id int, t double")
    right = spark.createDataFrame([(11, 5.0), (12, 15.0), (13, 35.0)], "id int, t double")
    found = {r.id: r.r_id for r in joins.asof_nearest(left, right, 5.0).collect()}
    assert found == {1: 11, 2: 13, 3: None}


@pytest.mark.parametrize("ranges", [1.0, 2.5, 50.0])
def test_asof_is_the_nearest_of_all_pairs(spark, ranges):
    rng = np.random.default_rng(8)
    left = [(i, float(rng.integers(0, 400)) / 4, int(rng.integers(2))) for i in range(120)] + [(200, 7.0, None), (201, None, 1)]
    right = [(i, float(rng.integers(0, 400)) / 4, int(rng.integers(2))) for i in range(60)] + [(300, 50.0, None)]
    found = joins.asof_nearest(spark.createDataFrame(left, "id int, t double, k int"), spark.createDataFrame(right, "id int, t double, k int"), 3.0, by=("k",), order="id", ranges=ranges)
    want = {}
    for i, t, k in left:
        near = [(abs(t - u), u > t, -j if u <= t else j, j) for j, u, m in right if k is not None and t is not None and m == k and abs(t - u) <= 3.0]
        want[i] = min(near)[3] if near else None
    assert {r.id: r.r_id for r in found.collect()} == want and any(v is None for v in want.values())


def test_rows_beside_and_numbers_cross_the_borders_of_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(t), int(i)) for g in "ab" for i, t in enumerate(rng.integers(-30, 90, 50))]
    df = spark.createDataFrame(rows, "g string, t double, i int").repartition(5)
    numbered = {(r.g, r.t, r.id): (r.i, r.n) for r in pieces.numbered(df.withColumnRenamed("i", "id"), ["g"], ["t", "id"], 7.0).collect()}
    beside = {(r.g, r.t, r.i): (r.before and r.before.v, r.after and r.after.v) for r in pieces.neighbours(df, ["g"], ["t", "i"], "i", 7.0).collect()}
    for g in "ab":
        own = sorted((t, i) for x, t, i in rows if x == g)
        for j, (t, i) in enumerate(own):
            assert numbered[g, t, i] == (j + 1, 50)
            assert beside[g, t, i] == (own[j - 1][1] if j else None, own[j + 1][1] if j < 49 else None)
    assert pieces.numbered(df.limit(0).withColumnRenamed("i", "id"), ["g"], ["t", "id"], 7.0).count() == 0


def test_interpolation_reaches_over_empty_ranges(spark):
    points = spark.createDataFrame([("a", 1.0, 10.0), ("a", 41.0, 50.0), ("b", 5.0, 1.0)], "g string, t double, v double")
    marks = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 21.0), ("a", 41.0), ("a", 41.5), ("b", 5.0), ("b", 6.0)], "g string, t double")
    for width in (2.0, 100.0):
        found = {(r.g, r.t): r.value for r in joins.interpolate(marks, points, "t", "v", "g", width).collect()}
        assert found == {("a", 0.0): None, ("a", 1.0): 10.0, ("a", 21.0): 30.0, ("a", 41.0): 50.0, ("a", 41.5): None, ("b", 5.0): 1.0, ("b", 6.0): None}


def test_an_ambiguous_key_picks_no_row(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "w")], "k int, v string")
    found = {r.k: (r.v, r.join_status) for r in joins.many_to_one(left, right, "k").collect()}
    assert found == {1: ("x", "MATCHED"), 2: (None, "AMBIGUOUS"), 3: (None, "UNMATCHED"), None: (None, "UNMATCHED")}
    assert [r.k for r in joins.unmatched_keys(left.na.drop(), right, "k").collect()] == [3]


def test_gap_fixture(spark):
    df = spark.createDataFrame([("p", 100, 2.5), ("p", 160, 8.0), ("p", 220, 1.0), ("p", 400, 3.0), ("q", 160, 1.0), ("q", 400, 0.5)], "node string, t long, v double")
    found = {(r.node, r.t): r.difference for r in ordered.gap_aware_difference(df, "node", "t", "v", 60).collect()}
    # at 160 q has no value an epoch before; at 400 nobody has
    assert found == {("p", 100): None, ("p", 160): 5.5, ("p", 220): -7.0, ("p", 400): None, ("q", 160): None, ("q", 400): None}


def test_separated_top_fixture(spark):
    stats = [3, 2, 6, 6, 1, 5, 4, 4.5, 0, 2, 7, 1]  # maxima: the second 6 (a step before it), 5, 4.5, 7
    df = spark.createDataFrame([("g", float(i), float(s)) for i, s in enumerate(stats)], "g string, x double, s double")
    peaks = ordered.local_maxima(df, ["g"], "x", "s", 4.0)
    assert sorted(r.x for r in peaks.collect()) == [3.0, 5.0, 7.0, 10.0]
    chosen = ordered.separated_top(peaks, "g", "x", "s", 2.5, 8)
    assert [r.x for r in chosen.orderBy("place").collect()] == [10.0, 3.0, 7.0]
    off = ordered.separated_top(peaks, "g", "x", "s", 2.5, 8, probes=[10.4], probe_width=0.5)
    assert [r.x for r in off.orderBy("place").collect()] == [3.0, 7.0]
    near = ordered.separated_top(peaks, "g", "x", "s", 2.5, 2, tolerance=0.5)
    assert [r.x for r in near.orderBy("place").collect()] == [10.0, 3.0]


def test_welch_and_coherence_add_up_over_segments(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=300).cumsum()
    y = 0.5 * x + rng.normal(size=300)
    df = spark.createDataFrame([("s", 2 * i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("short", 0, 1.0, 1.0)], "g string, t int, x double, y double")
    i = np.arange(300)
    a, b = (v - np.polyval(np.polyfit(i, v, 1), i) for v in (x, y))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    cut = lambda v: np.stack([v[k : k + 64] for k in range(0, 300 - 63, 32)])
    p = (np.abs(np.fft.rfft(cut(a) * w)) ** 2).mean(0) / (w @ w)
    p[1:-1] *= 2
    for width in (40.0, 1e9):
        found = [r.density for r in series.welch(df, "g", "t", "x", width, most=100).orderBy("k").collect()]
        assert np.allclose(found, p)
    f, g = (np.fft.rfft((cut(v) - cut(v).mean(1, keepdims=True)) * w) for v in (a, b))
    c = np.abs((np.conj(f) * g).mean(0)) ** 2 / ((np.abs(f) ** 2).mean(0) * (np.abs(g) ** 2).mean(0))
    assert np.allclose([r.coherence for r in series.coherence(df, "g", "t", "x", "y", 40.0, most=100).orderBy("k").collect()], c)


def test_normality_statistic_of_known_samples(spark):
    rng = np.random.default_rng(11)
    rows = [("normal", float(v)) for v in rng.normal(size=4000)] + [("skewed", float(v)) for v in rng.exponential(size=500)] + [("few", float(v)) for v in range(5)] + [("flat", 1.0)] * 20
    out = {r.g: r for r in robust.residual_summary(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert out["normal"].p > 0.001 and out["skewed"].p < 1e-12 and out["few"].k2 is None and out["flat"].k2 is None
    # under the null about 5 % of samples have p below 5 %
    many = spark.createDataFrame([(str(i % 400), float(v)) for i, v in enumerate(rng.normal(size=400 * 60))], "g string, v double")
    share = robust.residual_summary(many, "g", "v").where("p < 0.05").count() / 400
    assert 0.02 < share < 0.09


def test_frequency_scores_find_the_amplitude(spark):
    t = np.arange(200.0)
    y = 1.5 * np.cos(2 * np.pi * 0.05 * t) - 0.5 * np.sin(2 * np.pi * 0.05 * t)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, y)], "t double, y double")
    best = series.frequency_scores(df, "t", "y", [0.03, 0.05, 0.08]).orderBy(F.desc("power")).first()
    assert best.frequency == 0.05 and abs(best.a - 1.5) < 1e-9 and abs(best.b + 0.5) < 1e-9


def test_proportional_series_are_coherent(spark):
    v = np.random.default_rng(1).normal(size=64)
    df = spark.createDataFrame([("k", i, float(a), float(3 * a + 1)) for i, a in enumerate(v)], "k string, i int, x double, y double")
    found = [r.coherence for r in series.coherence(df.withColumnRenamed("k", "name"), "name", "i", "x", "y", 20.0, most=16).where("k > 0").collect()]
    assert len(found) == 8 and min(found) > 0.999


def test_robust_summary_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5, "g string, v double")
    row = robust.residual_summary(df, "g", "v").first()
    assert (row.n, row.mad, row.beyond) == (5, 0.0, 0.0)


def test_wilson_and_rotation(spark):
    row = spark.range(1).select(scalars.wilson_lower(F.lit(0), F.lit(10)).alias("w"), scalars.wilson_lower(F.lit(5), F.lit(0)).alias("n"), *[c.alias(n) for c, n in zip(scalars.rotate_shear(F.lit(0.3), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), "tx")]).first()
    assert abs(row.w) < 1e-12 and row.n is None and abs(row.t - 0.3) < 1e-12 and abs(row.x) < 1e-12


def test_sky_pairs_meet_across_the_seam(spark, tmp_path):
    ra, dec = lambda k: k * 37 % 3600 / 10, lambda k: k * 53 % 100 / 10
    lens, source = list(range(1, 401)), list(range(1, 3601))
    spark.createDataFrame([(k,) for k in lens], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k,) for k in source], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found = {(r.lens, r.source): r for r in registry.QUERIES["haversine_rotation_pairs"](spark, str(tmp_path)).collect()}
    a, b = np.array(lens)[:, None], np.array(source)[None, :]
    la, lb = np.radians(dec(a)), np.radians(dec(b))
    d = np.degrees(2 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(ra(b) - ra(a)) / 2) ** 2)))
    expected = {(int(a[i, 0]), int(b[0, j])) for i, j in zip(*np.nonzero((d <= 1.5) & (d > 0)))}
    seam = {(x, y) for x, y in expected if abs(ra(x) - ra(y)) > 180}
    assert seam and set(found) == expected
    for x, y in seam:
        east = (ra(y) - ra(x) + 180) % 360 - 180
        angle, e1, e2 = np.arctan2(dec(y) - dec(x), east * np.cos(np.radians(dec(x)))), y % 7 / 10, y % 5 / 10
        assert abs(found[x, y].tangential + e1 * np.cos(2 * angle) + e2 * np.sin(2 * angle)) < 2e-6


def test_manifest_precedence(spark):
    a = spark.createDataFrame([("x", 3, "s"), ("y", 3, "s"), ("z", 3, "s"), ("w", 3, "s")], "path string, byte_count long, sha256 string")
    b = spark.createDataFrame([("x", 3, "s"), ("y", 4, "q"), ("z", 3, "q"), ("v", 1, "t")], "path string, byte_count long, sha256 string")
    assert {r.path: r.status for r in custody.verify(a, b).collect()} == {"x": "OK", "y": "BYTE_COUNT_MISMATCH", "z": "SHA256_MISMATCH", "w": "MISSING", "v": "UNLISTED"}


def test_pairs_are_worked_out_once_for_rows_alike(spark, monkeypatch, tmp_path):
    spark.range(0, 7200, 1800).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(7200).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    from plumbline.operators import sky

    seen, plain = [], sky.pairs_within
    monkeypatch.setattr(sky, "pairs_within", lambda a, b, degrees: seen.append((a.count(), b.count())) or plain(a, b, degrees))
    out = registry.QUERIES["haversine_rotation_pairs"](spark, str(tmp_path)).collect()
    assert seen == [(2, 3600)]  # of 4 and 7,200 rows
    place = lambda k: (k * 37 % 3600 / 10.0, k * 53 % 100 / 10.0)
    far = lambda a, b: np.degrees(2 * np.arcsin(np.sqrt(np.sin(np.radians(b[1] - a[1]) / 2) ** 2 + np.cos(np.radians(a[1])) * np.cos(np.radians(b[1])) * np.sin(np.radians(b[0] - a[0]) / 2) ** 2)))
    want = {(i, j) for i in range(0, 7200, 1800) for j in range(7200) if 0 < far(place(i), place(j)) <= 1.5}
    assert want and {(r.lens, r.source) for r in out} == want and len(out) == len(want)
