"""Network, profiled, null, lensing, spectral and verdict operators against closed forms and brute force."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import fringe, lens, network, nulls, sealed, series, sky, verdicts
from plumbline.sources import text


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_gps_seconds_round_trip_and_leaps(spark):
    at = [datetime.datetime(*d, tzinfo=datetime.timezone.utc).timestamp() for d in ((2000, 1, 1, 11, 59, 47), (2005, 12, 31), (2006, 1, 1), (2017, 1, 2), (2024, 12, 12))]
    rows = frame(spark, [(x,) for x in at], "t double").select("t", scalars.gps_second(F.col("t")).alias("g"), scalars.unix_second(scalars.gps_second(F.col("t"))).alias("b")).collect()
    assert all(r.t == r.b for r in rows)
    assert [r.g - (r.t - at[0]) for r in rows] == [0, 0, 1, 5, 5]


def test_segments_and_guards(spark):
    days = frame(spark, [(datetime.date(2024, 12, 12),)], "day date")
    rows = network.segments(days, ["03:00", "12:30"], [3600.0, 1800.0]).orderBy("start").collect()
    base = datetime.datetime(2024, 12, 12, tzinfo=datetime.timezone.utc).timestamp()
    assert [(r.label, r.start - base, r.stop - base) for r in rows] == [("2024-12-12-b1-p1", 10800, 14400), ("2024-12-12-b1-p2", 14400, 16200), ("2024-12-12-b2-p1", 45000, 48600), ("2024-12-12-b2-p2", 48600, 50400)]
    kept = network.guarded(frame(spark, [(float(x),) for x in range(10)], "t double"), "t", 0, 10, 2)
    assert [r.t for r in kept.collect()] == [2, 3, 4, 5, 6, 7]


def _network(spark):
    rng = np.random.default_rng(5)
    place, z = rng.normal(size=(4, 3)) * 20, rng.normal(size=(4, 60))
    velocity = [(3.0, 1.0, 0.0), (0.0, -2.0, 5.0), (1.0, 1.0, 1.0)]
    v = np.array(velocity)
    delay = (place - place.mean(0)) @ (v / (v**2).sum(1, keepdims=True)).T
    places = frame(spark, [(f"n{i}", *map(float, p)) for i, p in enumerate(place)], "node string, x double, y double, z double")
    values = frame(spark, [(f"n{i}", k, float(z[i, k])) for i in range(4) for k in range(60)], "node string, k long, z double")
    return z, delay, values, network.delays(places, velocity), frame(spark, [(f"n{i}", 0.2 * (i + 1)) for i in range(4)], "node string, w double")


def test_surface_is_the_weighted_sum_of_interpolated_values(spark):
    z, delay, values, delays, weights = _network(spark)
    assert np.allclose([r.delay for r in delays.orderBy("node", "template").collect()], delay.ravel())
    found = {(r.template, r.centre): r.score for r in network.surface(values, delays, weights).collect()}
    want = {}
    for t in range(3):
        for c in range(-60, 120):
            at = c + delay[:, t]
            if (np.floor(at) >= 0).all() and (np.floor(at) + 1 < 60).all():
                want[t, c] = sum(0.2 * (i + 1) * np.interp(at[i], np.arange(60), z[i]) for i in range(4))
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    best = network.best_hit(network.surface(values, delays, weights)).first()
    assert abs(best.statistic - max(map(abs, want.values()))) < 1e-9


def test_an_injected_impulse_is_found(spark):
    _, delay, values, delays, weights = _network(spark)
    loud = network.inject(values, delays, 1, 30.0, 500.0)
    best = network.best_hit(network.surface(loud, delays, weights)).first()
    moved = loud.join(values.withColumnRenamed("z", "z0"), ["node", "k"]).where("z - z0 > 400").collect()
    assert {(r.node, r.k) for r in moved} == {(f"n{i}", round(30 + d)) for i, d in enumerate(delay[:, 1])}
    assert best.template == 1 and abs(best.centre - 30) <= 1 and loud.count() == 240


def test_missing_nodes_invalidate_a_centre(spark):
    _, _, values, delays, weights = _network(spark)
    assert network.surface(values.where("node <> 'n2'"), delays, weights).count() == 0


def test_covariance_weights():
    w = network.covariance_weights(np.diag([1.0, 4.0]))
    assert np.allclose(w, np.array([1.0, 0.25]) / math.sqrt(1.25))
    with pytest.raises(ValueError):
        network.covariance_weights(np.array([[-1.0]]))


def _fringe(spark):
    rng = np.random.default_rng(7)
    rows, blocks = [], []
    for g, n in (("a", 80), ("b", 60)):
        t = np.sort(rng.uniform(0, 200, n))
        u, phi, m = 2 * (t - t[0]) / (t[-1] - t[0]) - 1, rng.uniform(0, 2 * np.pi, n), rng.normal(size=n)
        x = np.stack([np.ones(n), u, np.cos(phi), np.sin(phi), u * np.cos(phi), u * np.sin(phi)], 1)
        scale = {"a": 0.5, "b": 2.0}[g]
        y = x @ rng.normal(size=6) + m * 0.3 * np.cos(2 * np.pi * 0.07 * t) + scale * 0.1 * rng.normal(size=n)
        rows += [(g, *map(float, r)) for r in zip(t, u, phi, m, np.full(n, scale), y)]
        blocks.append((t, x / scale, m / scale, y / scale, x, y))
    df = frame(spark, rows, "g string, t double, u double, phi double, m double, s double, y double")
    return blocks, df.select("*", *[c.alias(f"x{i}") for i, c in enumerate(fringe.nuisance_terms(F.col("u"), F.col("phi")))])


def test_profiled_scores_equal_projected_least_squares(spark):
    blocks, df = _fringe(spark)
    terms = [f"x{i}" for i in range(6)]
    found = {r.frequency: r for r in fringe.profiled_scores(df, "g", "t", "y", terms, [0.03, 0.07], F.col("m"), F.col("s")).collect()}
    for f in (0.03, 0.07):
        gram, score = np.zeros((2, 2)), np.zeros(2)
        for t, x, m, y, _, _ in blocks:
            z = m[:, None] * np.stack([np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)], 1)
            z = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
            gram += z.T @ z
            score += z.T @ (y - x @ np.linalg.lstsq(x, y, rcond=None)[0])
        q = np.linalg.solve(gram, score)
        assert np.allclose([found[f].q_cos, found[f].q_sin, found[f].statistic], [*q, score @ q])
    assert found[0.07].statistic > found[0.03].statistic and abs(found[0.07].q_cos - 0.3) < 0.1
    betas = {r.g: r.beta for r in fringe.fit_groups(df, "g", "y", terms).collect()}
    for g, b in zip("ab", blocks):
        assert np.allclose(betas[g], np.linalg.lstsq(b[4], b[5], rcond=None)[0])


def test_gram_and_phase_proxy(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    df = frame(spark, [("k", *map(float, r)) for r in x] + [("k", None, 1.0, 1.0)], "g string, a double, b double, c double")
    got = {(r.i, r.j): r.v for r in fringe.gram(df.repartition(3), ["a", "b", "c"], "g").collect()}
    assert np.allclose([got[i, j] for i in range(3) for j in range(3)], (x.T @ x).ravel())
    arms = frame(spark, [("k", 1.0 + i, 2.0, 1.0, -1.0, 3.0, 2.0) for i in range(10)], "g string, c1 double, r1 double, s1 double, c2 double, r2 double, s2 double")
    out = fringe.phase_proxy(arms, "g", [("c1", "r1", "s1"), ("c2", "r2", "s2")]).orderBy("c1").collect()
    assert len(out) == 9 and abs(out[0].phase - (2.0 * 2 - 0.75) / (4 + 0.25)) < 1e-12


def test_fringe_slope_is_the_derivative(spark):
    beta = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
    fit = lambda p: sum((b * c for b, c in zip(beta, fringe.nuisance_terms(F.lit(0.5), F.lit(p)))), F.lit(0.0))
    r = spark.range(1).select(((fit(1.0001) - fit(0.9999)) / 2e-4).alias("n"), fringe.fringe_slope(beta, F.lit(0.5), F.lit(1.0)).alias("a")).first()
    assert abs(r.n - r.a) < 1e-6


def test_rank_and_critical_values(spark):
    null = frame(spark, [("f", float(v)) for v in (1, 2, 2, 3)] + [("g", 5.0)], "family string, statistic double")
    targets = frame(spark, [("f", 2.0), ("f", 9.0), ("f", 0.0), ("h", 1.0)], "family string, statistic double")
    assert {(r.family, r.statistic): r.p for r in nulls.rank_pvalue(targets, null).collect()} == {("f", 2.0): 0.8, ("f", 9.0): 0.2, ("f", 0.0): 1.0, ("h", 1.0): None}
    assert {r.family: r.critical for r in nulls.critical_value(null, 0.4).collect()} == {"f": 2.0, "g": None}


def test_shift_and_permutation_tables(spark):
    sizes = frame(spark, [("a", 7), ("b", 2), ("c", 1)], "group string, n long")
    shifts = nulls.shift_table(sizes, 50, 3)
    rows = shifts.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, nulls.shift_table(sizes.repartition(3), 50, 3).collect()))
    assert {r.shift for r in rows if r.group == "a"} == set(range(1, 7)) and {r.shift for r in rows if r.group == "b"} == {1} and not [r for r in rows if r.group == "c"]
    perms = nulls.permutation_table(spark, 8, 20, 1).groupBy("draw").agg(F.sort_array(F.collect_list("source")).alias("s"), F.array_agg("source").alias("o")).collect()
    assert len(perms) == 20 and all(p.s == list(range(8)) for p in perms) and len({tuple(p.o) for p in perms}) > 15


def test_identity_permutation_gives_the_coherence(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 8, 2))
    blocks = frame(spark, [("x", i, *map(float, a[i]), *map(float, b[i])) for i in range(8)] + [("few", 0, 1.0, 0.0, 1.0, 0.0)], "name string, block int, ar double, ai double, br double, bi double")
    same = frame(spark, [(0, i, i) for i in range(8)], "draw long, block int, source int")
    ca, cb = a @ [1, 1j], b @ [1, 1j]
    want = abs(np.vdot(ca, cb)) ** 2 / (np.vdot(ca, ca).real * np.vdot(cb, cb).real)
    assert abs(nulls.coherence_null(blocks, same).first().statistic - want) < 1e-12


def test_power_grows_with_amplitude(spark):
    cross = np.zeros((2, 2, 2, 2))
    cross[0, 0], cross[1, 1] = np.eye(2) * 10, np.eye(2) * 10
    grid = {(r.frequency, r.amplitude): (r.detected, r.identified) for r in nulls.power_grid(spark, np.zeros((2, 2)), cross, [0.2, 0.1], [0.1, 1.0], 5.0).collect()}
    assert grid == {(0.2, 0.1): (0.0, 0.0), (0.2, 1.0): (1.0, 1.0), (0.1, 0.1): (0.0, 0.0), (0.1, 1.0): (1.0, 1.0)}


def test_deprojection_of_an_isothermal_profile(spark):
    radius = [0.03 * 1.5**k for k in range(8)]
    profiles = frame(spark, [(1, r, 1e12 / r) for r in radius] + [(2, r, 1e12 / r if i < 2 else -1.0) for i, r in enumerate(radius)], "lens int, radius double, esd double")
    masses = frame(spark, [(1, 1e11), (2, 1e11)], "lens int, mass double")
    rows = lens.deproject_lenses(profiles, masses, [1e-12, 1e-11], -1.0, -1.0, 2048).collect()
    assert {r.lens for r in rows} == {1}
    for r in rows:
        at = math.sqrt(lens.G_SI * 1e11 * lens.SOLAR_MASS_KG / r.gbar) / lens.MPC_M
        assert abs(r.gobs / (4 * lens.G_MPC * 1e12 / at * 1e6 / lens.MPC_M) - 1) < 1e-5
    with pytest.raises(ValueError):
        lens.deproject_lenses(profiles, masses, [1e-12], -1.0, -1.0, 10)


@pytest.mark.parametrize("interpolation", ["linear", "quadratic"])
@pytest.mark.parametrize("tail", ["sis", "flat", "zero"])
def test_deprojection_operator(spark, interpolation, tail):
    radius = np.linspace(1.0, 4.0, 7)
    a = np.zeros((7, 7))
    for r in lens.deprojection_operator(spark, radius.tolist(), 256, interpolation, tail).collect():
        a[r.i, r.j] = r.v
    at, w = np.polynomial.legendre.leggauss(256)
    query = radius[:, None] / np.sin((at + 1) * math.pi / 4)
    # a profile that both interpolations carry exactly
    shape = (lambda r: 3 - 0.5 * r) if interpolation == "linear" else (lambda r: 3 - 0.5 * r + 0.1 * r * r)
    beyond = {"sis": shape(4.0) * 4.0 / query, "flat": shape(4.0) + 0 * query, "zero": 0 * query}[tail]
    want = (np.where(query <= 4.0, shape(query), beyond) * w * math.pi / 4).sum(1)
    assert np.allclose(a @ shape(radius), want)


def test_operator_status_order(spark):
    rows = [(1.0, 2.0, 1.0, 1.0, 1.0, 0.1), (1.0, 2.0, 1.0, 1.0, 1.0, 5.0), (1.0, 2.0, -3.0, 1.0, 1.0, 0.1), (1.0, 2.0, 1.0, 1.0, 9.0, 0.1), (-1.0, 2.0, 1.0, 1.0, 1.0, 0.1), (1.0, 2.0, 1.0, 1.0, 1.0, 0.0), (1.0, 2.0, 1.0, 1.0, 1.0, None)]
    out = lens.operator_status(frame(spark, rows, "exact double, sis double, zero double, flat double, quadratic double, sigma double").coalesce(1)).collect()
    assert [r.status.split("_", 2)[-1] for r in out] == ["RESOLVED_CONDITIONAL_95", "STATISTICALLY_UNRESOLVED_95", "UNRESOLVED_SYSTEMATICS", "UNRESOLVED_SYSTEMATICS"] + ["NONPOSITIVE_OR_DEGENERATE"] * 3


def test_covariance_checks_find_faults(spark):
    c = [(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.5), (1, 1, 1.0), (2, 2, 0.0), (0, 2, 0.0)]
    r = lens.covariance_checks(frame(spark, c, "i int, j int, v double")).first()
    assert (r["size"], r.cells, r.missing, r.asymmetric, r.diagonal_bad, r.max_correlation) == (3, 6, 3, 3, 1, 0.75)


def test_periodogram_and_whittle(spark):
    n = 64
    y = np.cos(2 * np.pi * 8 * np.arange(n) / n) + 0.01 * np.arange(n)
    df = frame(spark, [("k", i, float(v)) for i, v in enumerate(y)] + [("short", 0, 1.0)], "g string, i int, v double")
    p = series.periodogram(df, "g", "i", "v", 2.0).collect()
    assert {r.g for r in p} == {"k"} and max(p, key=lambda r: r.density).frequency == 8 / n / 2
    line = np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n))
    assert abs(sum(r.density for r in p) / (2.0 * n) - ((y - line) ** 2).mean()) < 1e-9
    bins = frame(spark, [("k", 1.0, 2.0), ("k", 3.0, 0.0), ("k", 2.0, 4.0), ("k", None, 4.0), ("z", 1.0, -1.0)], "g string, observed double, model double")
    assert [(r.g, r.bins, round(r.loglik, 9)) for r in series.whittle(bins, "g").collect()] == [("k", 2, round(-(math.log(2) + 0.5 + math.log(4) + 0.5), 9))]
    base = series.whittle_baseline(df, "g", "i", "v", 20.0).collect()
    assert [(r.g, r.bins) for r in base] == [("k", 32)]


def test_block_coefficients(spark):
    rng = np.random.default_rng(4)
    t, v, w = np.sort(rng.uniform(0, 10, 30)), rng.normal(size=30), rng.uniform(0.5, 2, 30)
    df = frame(spark, [("a", *map(float, r)) for r in zip(t, v, w)] + [("b", 0.0, 1.0, 1.0)], "g string, t double, v double, w double")
    rows = {r.g: r for r in series.block_coefficients(df, ["g"], "t", "v", 0.3, 1.0, "w").collect()}
    root = np.sqrt(w)
    x = np.stack([np.ones(30), t], 1)
    res = v - x @ np.linalg.lstsq(x * root[:, None], v * root, rcond=None)[0]
    want = (w * res * np.exp(-2j * np.pi * 0.3 * (t - 1.0))).sum() / math.sqrt(w.sum())
    assert np.allclose([rows["a"].re, rows["a"].im], [want.real, want.imag]) and rows["b"].re is None
    blocks = series.equal_blocks(df.where("g = 'a'"), "t", 4).groupBy("block").count().collect()
    assert {r.block for r in blocks} <= {0, 1, 2, 3} and sum(r["count"] for r in blocks) == 30


def test_allan_deviation(spark):
    x = np.random.default_rng(8).normal(size=40)
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(x)], "g string, i long, v double")
    for r in series.allan_deviation(df, "g", "i", "v", [1, 3, 30]).collect():
        means = np.convolve(x, np.ones(r.m) / r.m, "valid")
        d = means[r.m :] - means[: -r.m]
        assert r.m != 30 and r.n == len(d) and abs(r.deviation - math.sqrt((d**2).mean() / 2)) < 1e-9


def test_probe_states(spark):
    schema = "http_status int, observed_bytes long, expected_bytes long, columns array<string>, required array<string>, rows long, expected_rows long"
    probes = [(206, 5, 5, ["b", "a"], ["a", "b"], 3, 3), (200, 5, 5, ["a"], ["c", "b", "a"], 3, None), (200, None, 5, ["a"], ["a"], 3, None), (200, 5, 5, ["a"], ["a"], None, 3), (404, 5, 5, ["a"], ["a"], 3, 3), (None, 5, 5, ["a"], ["a"], 3, 3)]
    out = verdicts.probe_status(frame(spark, probes, schema).coalesce(1))
    rows = out.collect()
    assert [r.probe_status.split("_")[-1] for r in rows] == ["VERIFIED", "DRIFT", "DRIFT", "DRIFT", "STATUS", "STATUS"] and rows[1].missing == ["b", "c"]
    assert tuple(verdicts.recoverability(out).first()) == (False, 6, 30, "NOT_READY_INPUT_FAILED_OR_DRIFTED")
    assert verdicts.recoverability(out.where("http_status = 206")).first().all_verified


def test_ledger_and_vectors(spark):
    ledger = frame(spark, [("a",)], "claim_id string")
    claims = frame(spark, [("a", 1, "x"), ("b", 1, "x"), ("b", 2, "x"), ("c", 1, "y"), ("c", 2, "x"), ("d", 1, None)], "claim_id string, seq int, jurisdiction string")
    got = {(r.claim_id, r.seq): r.ledger_decision for r in verdicts.append_claims(ledger, claims, "x").collect()}
    assert got == {("a", 1): "REFUSED_DUPLICATE_ID", ("b", 1): "APPENDED", ("b", 2): "REFUSED_DUPLICATE_ID", ("c", 1): "REFUSED_JURISDICTION", ("c", 2): "APPENDED", ("d", 1): "REFUSED_JURISDICTION"}
    rows = frame(spark, [("k", "u", "OK"), ("k", "v", "OK"), ("k", "v", "BAD"), ("k", None, "OK")], "g string, c string, s string")
    assert verdicts.vector_status(rows, "g", "c", "s").first().channels == {"u": "OK", "v": "AMBIGUOUS"}
    assert {r.c: r.status for r in verdicts.cardinality_gate(rows.na.drop(), "c", 2).collect()} == {"u": "NOT_ESTIMABLE", "v": "ESTIMABLE"}


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.snap(F.lit(0.75), [1.0, 0.5], 0.3).alias("tie"),
        scalars.snap(F.lit(0.1), [0.5], 0.3).alias("off"),
        scalars.seed_commitment(F.lit("ab")).alias("bad"),
        scalars.safe_divide(F.lit(1.0), F.lit(0.0)).alias("nil"),
        scalars.fixed_acceleration_radius(F.lit(-1.0), F.lit(1e-10)).alias("neg"),
        scalars.seed_phase("s", F.lit("d")).alias("phase"),
    ).first()
    assert (r.tie, r.off, r.bad, r.nil, r.neg) == (0.5, None, None, None, None) and 0 <= r.phase < 1


def test_feeds(spark):
    doc = '{"parameters":[{"name":"Time"},{"name":"B"},{"name":"V"}],"data":[["2024-01-01T00:00:00Z","1.5",[1,2,3]],["bad","2",[1,2,3]],["2024-01-01T00:01:00Z",null,[4,"x",6]],["2024-01-01T00:02:00Z"]]}'
    rows = text.hapi_rows(frame(spark, [(doc,)], "json string"), ["B", "V_0", "V_1", "V_9"]).orderBy("time").collect()
    assert [tuple(r)[1:] for r in rows] == [(1.5, 1.0, 2.0, None), (None, 4.0, None, None)]
    mag = frame(spark, [(0.0, 0, 1.0), (60.0, 2, 2.0), (60.0, 1, 3.0), (500.0, 3, 4.0)], "time double, row int, bt double")
    wind = frame(spark, [(30.0, 0, 400.0), (100.0, 1, 500.0)], "time double, row int, speed double")
    assert [tuple(r) for r in text.merge_nearest(mag, wind, ["bt", "speed"], least=3).orderBy("time").collect()] == [(0.0, 1.0, 400.0, False), (60.0, 3.0, 400.0, False)]
    with pytest.raises(ValueError, match="density"):
        text.merge_nearest(mag, wind, ["bt", "density"])
    table = text.named_table(frame(spark, [("# h",), ("1 2",), ("3 x",), ("4",)], "value string"), ["a", "b"])
    assert [tuple(r) for r in table.collect()] == [(1.0, 2.0)]
    good = frame(spark, [(0, 3.0, 0.1), (1, 2.0, 0.0), (2, 1.0, 0.2)], "row int, x double, s double")
    assert text.strict_profile(good, "x", "s", 3).first().passes
    bad = good.withColumn("x", F.when(F.col("row") == 2, 2.0).otherwise(F.col("x"))).withColumn("s", F.when(F.col("row") == 0, -1.0).otherwise(F.col("s")))
    r = text.strict_profile(bad, "x", "s", 3).first()
    assert (r.bad, r.rises, r.passes) == (1, 1, False)


def test_injected_hits_equal_a_search_of_each_trial(spark):
    _, _, values, delays, weights = _network(spark)
    trials = [(t, f"n{i}", 20.0 + 7 * t + 1.3 * i * (-1) ** t, a) for t, a in enumerate((0.0, 0.4, 3.0, 50.0)) for i in range(4)]
    found = {r.trial: (round(r.statistic, 9), r.centre, r.template) for r in network.injected_hits(values, delays, weights, frame(spark, trials, "trial int, node string, arrival double, amplitude double")).collect()}
    for t in range(4):
        hits = frame(spark, [(n, math.ceil(at - 0.5), a) for k, n, at, a in trials if k == t], "node string, k long, a double")
        loud = values.join(hits, ["node", "k"], "left").select("node", "k", (F.col("z") + F.coalesce("a", F.lit(0.0))).alias("z"))
        r = network.best_hit(network.surface(loud, delays, weights)).first()
        assert found[t] == (round(r.statistic, 9), r.centre, r.template)


def test_sealed_challenge_hides_and_reveals(spark):
    seed = "0a" * 32
    labels = frame(spark, [("x", 0.1), ("y", 0.2), ("null", None)], "label string, frequency double")
    hidden = sealed.plan(labels, seed)
    rows = frame(spark, [(float(t), 1.0) for t in range(20)], "t double, y double")
    cases = sealed.seal(rows, hidden, "t", "y", 0.5)
    assert cases.columns == ["case_id", "t", "y"] and cases.count() == 60
    by = {r.label: r for r in hidden.collect()}
    want = 1 + 0.5 * math.cos(2 * math.pi * 0.1 * 3 - by["x"].phase)
    assert abs(cases.where((F.col("case_id") == by["x"].case_id) & (F.col("t") == 3)).first().y - want) < 1e-12
    assert cases.where((F.col("case_id") == by["null"].case_id) & (F.col("y") != 1.0)).count() == 0
    digests = sorted(map(tuple, sealed.seal_digest(cases, "t", "y").collect()))
    assert digests == sorted(map(tuple, sealed.seal_digest(cases.repartition(5), "t", "y").collect())) and len({d[2] for d in digests}) == 3
    said = frame(spark, [(by["x"].case_id, "x"), (by["null"].case_id, "y")], "case_id string, predicted string")
    good = hashlib.sha256(bytes.fromhex(seed)).hexdigest()
    assert {r.label: r.outcome for r in sealed.reveal(said, hidden, seed, good).collect()} == {"x": "CORRECT", "y": "MISSING", "null": "FALSE_ALARM"}
    assert {r.outcome for r in sealed.reveal(said, hidden, seed, "00").collect()} == {"SEED_MISMATCH"}


def test_covariances_are_judged_by_their_eigenvalues(spark):
    def check(m):
        cells = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m)) if np.isfinite(m[i, j])]
        return lens.covariance_checks(frame(spark, cells, "i int, j int, v double")).first()

    good = check(np.array([[4.0, 1.0], [1.0, 9.0]]))
    low, high = np.linalg.eigvalsh([[4.0, 1.0], [1.0, 9.0]])
    assert good.positive_definite and abs(good.least_eigenvalue - low) < 1e-12 and abs(good.condition - high / low) < 1e-9
    r = check(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert (r.positive_definite, r.condition, r.asymmetric, r.max_correlation) == (False, None, 0, 2.0)
    r = check(np.array([[1.0, 0.5], [0.4, 1.0]]))
    assert (r.positive_definite, r.asymmetric) == (None, 2)
    r = check(np.array([[1.0, np.nan], [0.4, 1.0]]))
    assert (r.positive_definite, r.missing) == (None, 1)
    assert lens.covariance_checks(frame(spark, [], "i int, j int, v double")).first().positive_definite is None


def test_critical_values_by_counts(spark):
    values = [5.0, 5.0, 4.0, 3.0, 3.0, 2.0, 1.0, 0.0, -1.0, -1.0]
    for alpha in (0.05, 0.1, 0.2, 0.35, 0.5, 0.9):
        place = math.floor(alpha * 11 - 1)
        want = sorted(values, reverse=True)[place] if place >= 0 else None
        r = nulls.critical_value(frame(spark, [("f", v) for v in values], "family string, statistic double"), alpha).first()
        assert (r.n, r.critical) == (10, want)


def test_times_with_and_without_a_zone(spark):
    df = frame(spark, [("2024-05-01 10:00:00",), ("2024-05-01T10:00:00+02:00",), ("2024-05-01T10:00:00Z",), ("nothing",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.iso(scalars.utc(F.col("s")))).collect()] == ["2024-05-01T10:00:00Z", "2024-05-01T08:00:00Z", "2024-05-01T10:00:00Z", None, None]


def test_profiles_as_columns_are_numpys_lines(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(6):
        n = int(rng.integers(2, 40))
        radius, value = np.sort(rng.uniform(0.01, 9, n)), rng.uniform(0.1, 5, n)
        rows += [(k, float(a), float(b)) for a, b in zip(radius, value)] + [(k, 1.0, None), (k, -1.0, 2.0), (k, float(radius[0]), 0.01)]
        for q in [*rng.uniform(0.001, 20, 20), radius[0], radius[-1], radius[n // 2]]:
            want[k, float(q)] = lens.log_profile(radius, value, np.array([q]), -1.0, -2.5)[0]
    rows += [(9, 1.0, 1.0), (10, None, 1.0)]  # too few bins
    knots = lens.profile_knots(spark.createDataFrame(rows, "k int, radius double, esd double"), "k")
    asked = spark.createDataFrame(list(want), "k int, q double").join(knots, "k")
    found = {(r.k, r.q): r.v for r in asked.select("k", "q", lens.log_log(F.col("knots"), F.col("q"), -1.0, F.lit(-2.5)).alias("v")).collect()}
    assert knots.count() == 6 and found == pytest.approx(want)


def test_operators_of_many_profiles_are_their_own(spark):
    lists = {"a": [0.1, 0.2, 0.5, 1.1], "b": [1.0, 2.0, 3.0], "c": [1.0, 2.0]}
    rows = [(k, i, r) for k, x in lists.items() for i, r in enumerate(x)]
    found = lens.deprojection_operators(spark.createDataFrame(rows, "name string, i int, radius double").repartition(3), "name", 128).collect()
    for k in "ab":
        own = {(r.i, r.j): r.v for r in found if r.name == k}
        assert own == {(r.i, r.j): r.v for r in lens.deprojection_operator(spark, lists[k], 128).collect()} and len(own) == len(lists[k]) ** 2
    assert {r.name for r in found} == {"a", "b"}


@pytest.mark.parametrize("degrees", [0.7, 6.0])
def test_sky_pairs_at_the_poles_are_all_found(spark, degrees):
    rng = np.random.default_rng(10)
    dec = np.concatenate([rng.uniform(80, 90, 60), rng.uniform(-90, -84, 60), [90.0, -90.0, 89.99], rng.uniform(-60, 60, 40)])
    ra = rng.uniform(0, 360, len(dec))
    ra[:10], dec[:10] = rng.uniform(10, 11, 10), rng.uniform(85, 85.5, 10)  # a crowded cell
    side = lambda n, pick: spark.createDataFrame([(int(i), float(ra[i]), float(dec[i])) for i in pick], f"{n} int, ra double, dec double")
    lenses, sources = range(0, len(dec), 2), range(1, len(dec), 2)
    found = {(r.lens, r.source): r.degrees for r in sky.pairs_within(side("lens", lenses), side("source", sources), degrees).collect()}
    xyz = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], 1)
    apart = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(xyz[:, None] - xyz[None], axis=2) / 2, 0, 1)))
    want = {(i, j): apart[i, j] for i in lenses for j in sources if 0 < apart[i, j] <= degrees}
    assert set(found) == set(want) and found == pytest.approx(want, abs=1e-6)
