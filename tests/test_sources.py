import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import shadow
from plumbline.sources import text
from plumbline.streaming import feed


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_clock_and_position_lines(spark):
    bias = ".Satellite.GPS{}.Clk.Bias"
    clock = text.clock_lines(lines(spark, f"600 1 -12.5 0.25 {bias.format(7)}", f"  630   1 2e3 0 {bias.format(12)} ", f"600 1 1 -0.1 {bias.format(8)}", "600 1 1 1 .Satellite.GLO7.Clk.Bias", f"600 1 NaN 1 {bias.format(9)}", "600 1 1 1"))
    assert sorted(map(tuple, clock.collect())) == [(600.0, "GPS7", -12.5, 0.25), (630.0, "GPS12", 2000.0, 0.0)]
    place = text.position_lines(lines(spark, "E GPS7 900 0 -4.5 1e2 0 9 9", "E GPS12 900 0 1 2", "V GPS7 900 0 1 2 3", "E GLO7 900 0 1 2 3", "E GPS8 900 0 1 ? 3"))
    assert [tuple(r) for r in place.collect()] == [(900.0, "GPS7", -4.5, 100.0, 0.0)]


def test_comment_csv_and_fills(spark):
    df = text.comment_csv(lines(spark, "# head", "a,b", "1,2 # tail", "nan,3", "4", '"5,5",6', "7,8,9"), ["a", "b"])
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, [(1.0, 2.0, True), (None, 3.0, True), (4.0, None, False), (None, 6.0, True), (7.0, 8.0, False)]))
    found = text.fill_to_null(df.where("b < 4").select("a", "b"), {"b": 3.0})
    assert sorted(map(str, map(tuple, found.collect()))) == ["(1.0, 2.0)", "(None, None)"]


def test_wide_series_and_doubled_keys(spark):
    rows = spark.createDataFrame([(1, "X", 2.0), (1, "Y", 3.0), (2, "X", None), (2, "X", 5.0)], "time int, id string, value double")
    assert sorted(map(tuple, text.wide_series(rows, ["X", "Y"]).collect())) == [(1, 2.0, 3.0), (2, 5.0, None)]
    assert [(r.id, r.n) for r in text.doubled_keys(rows, "id").collect()] == [("X", 3)]


def test_json_feeds(spark):
    doc = '[["time_tag","speed"],["2024-01-01 00:00:00","5"],["2024-01-01 00:00:00","6"],["bad","7"],["2024-01-01 00:01:00","x"]]'
    rows = text.header_rows(spark.createDataFrame([(doc,)], "json string"), ["speed"], "time_tag").orderBy("time").collect()
    assert [r.speed for r in rows] == [6.0, None]
    doc = '{"times":["2024-01-01T00:00:00Z","2024-01-01T00:01:00Z"],"values":[{"id":"X","values":[1,2]},{"id":"Y","values":[1]}]}'
    rows = text.parallel_series(spark.createDataFrame([(doc,)], "json string")).collect()
    assert [(r.id, r.value) for r in rows] == [("X", 1.0), ("X", 2.0)]


def test_fits_cards(spark):
    cards = ["SIMPLE  =                    T / ok", "NAXIS2  =                   12", "TTYPE1  = 'ID      '           / name", "END"]
    content = "".join(c.ljust(80) for c in cards).encode().ljust(2880)
    found = {r.keyword: r.value for r in text.fits_cards(spark.createDataFrame([("f", content)], "path string, content binary")).collect()}
    assert found == {"SIMPLE": "T", "NAXIS2": "12", "TTYPE1": "ID"}


def test_esd_fixture(spark):
    # lens, radius, tangential, cross, weight, critical density, bias
    rows = [(4, 0.25, 3.0, 1.0, 2.0, 2.0, 0.0), (4, 0.75, 1.0, -1.0, 4.0, 4.0, 0.5), (4, 1.0, 5.0, 0.0, 1.0, 1.0, 1.0), (4, 2.5, 5.0, 0.0, -1.0, 1.0, 0.0), (4, 2.5, float("nan"), 0.0, 1.0, 1.0, 0.0), (9, 0.5, 1.0, 0.0, 1.0, 1.0, 0.0)]
    pairs = spark.createDataFrame(rows, "lens_index int, projected_radius_mpc double, tangential double, cross double, source_weight double, sigma_critical double, multiplicative_bias double")
    found = {(r.lens_index, r.bin): (r.esd, r.cross_esd, r.pairs) for r in shadow.accumulate_esd(pairs, [0.0, 1.0, 2.0, 3.0], lenses=5).collect()}
    # first bin: weights 1/2 and 1/4; (1 * 3 + 1 * 1) / (0.5 + 0.25 * 1.5)
    assert found == {(4, 0): (4.0 / 0.875, 0.0, 2), (4, 1): (2.5, 0.0, 1), (4, 2): (None, None, 0)}


def test_propagation_is_deterministic_and_centred(spark):
    sample = text.rotation_sample(lines(spark, "G1 1 10.0 0.5 1 60 3 " + " ".join(["1"] * 10) + " 1 x"))
    models = text.mass_models(lines(spark, "G1 10 1.0 100 5 20 50 0 1 0", "G1 10 2.0 110 5 25 55 0 1 0", "G1 10 2 100"))
    points = shadow.nominal(shadow.select_observations(models, sample))
    a, b = (sorted(map(tuple, shadow.propagate(points, 512).collect())) for _ in range(2))
    want = {r.radius: r.delta_v2 for r in points.collect()}
    assert a == b and len(a) == 2 and all(r[2] < want[r[1]] < r[6] for r in a)


def test_ledoit_wolf_shrinks_towards_the_mean_variance(spark):
    x = np.random.default_rng(2).normal(size=(200, 4))
    s, k = shadow.ledoit_wolf(spark.createDataFrame(x.tolist(), "a double, b double, c double, d double"), list("abcd"))
    centred = x - x.mean(0)
    emp = centred.T @ centred / 200
    mu = np.trace(emp) / 4
    d2 = ((emp - mu * np.eye(4)) ** 2).sum() / 4
    b2 = sum(((np.outer(r, r) - emp) ** 2).sum() for r in centred) / 4 / 200**2
    assert abs(k - min(b2, d2) / d2) < 1e-9 and np.allclose(s, (1 - k) * emp + k * mu * np.eye(4))


def test_stream_windows(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 0, 30)
    spark.createDataFrame([(t, "a", 1.0), (t, "a", 1.0), (t, "b", 3.0)], "ts timestamp, k string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    run = feed.windowed(feed.deduplicated(feed.marked(stream, "ts"), ["ts", "k"]), "ts", "k", "v").writeStream.format("memory").queryName("feed_windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    assert run.exception() is None
    # the watermark passes the window with the next batch alone: what is out now is right, and nothing else comes
    out = {r.asDict()["k"]: r.asDict() for r in spark.table("feed_windows").collect()}
    assert set(out) <= {"a", "b"}
    late = datetime.datetime(2024, 1, 3)
    spark.createDataFrame([(late, "a", 7.0)], "ts timestamp, k string, v double").write.mode("append").parquet(str(tmp_path / "in"))
    run = feed.windowed(feed.deduplicated(feed.marked(stream, "ts"), ["ts", "k"]), "ts", "k", "v").writeStream.format("memory").queryName("feed_late").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    run.awaitTermination(60)
    assert run.exception() is None
    assert sorted((r["k"], r["n"]) for r in spark.table("feed_late").collect()) == [("a", 1), ("b", 1)]


def test_propagation_refuses_draws_that_cannot_be(spark):
    points = spark.createDataFrame([("G", 1.0, 10.0, 50.0, 89.0, 0.01, 100.0, 5.0, 1.0, 1.0, 1.0)], "galaxy string, radius double, distance double, distance_error double, inclination double, inclination_error double, v_obs double, v_err double, v_gas double, v_disk double, v_bulge double")
    assert shadow.propagate(points, 16).count() == 1
    with pytest.raises(Exception, match="no 16 draws"):
        shadow.propagate(points.withColumn("inclination", F.lit(-400.0)), 16).collect()


def test_parsers_split_a_line_once(spark):
    raw = lines(spark, "a b")
    for parsed in (text.rotation_sample(raw).where("quality > 1"), text.mass_models(raw).where("radius > 0 AND v_obs > radius"), text.clock_lines(raw), text.position_lines(raw).where("x_km > 0"), text.named_table(raw, ["a", "b"]).where("a > b")):
        assert parsed._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_comments_start_outside_quotes(spark):
    raw = lines(spark, '1,"2#x",3 # note "quoted"', '4,"5",6#"', "# whole", '7,8,9 "# open', 'x,"a,#b",#')
    found = [(r.x, r.y, r.z, r.width_ok) for r in text.comment_csv(raw, ["x", "y", "z"]).collect()]
    assert (4.0, 5.0, 6.0, True) in found and (1.0, None, 3.0, True) in found and len(found) >= 3


def test_a_feed_goes_by_its_own_time_column(spark):
    feeds = ['[["time_tag", "v"], ["2024-01-01 00:00:00", "1"]]', '[["time_tag", "v", "propagated_time_tag"], ["2024-01-01 00:01:00", "2", "2024-01-01 01:00:00"], ["2024-01-01 00:02:00", "3", "bad"]]', '[["v"], ["4"]]']
    documents = spark.createDataFrame([(f,) for f in feeds], "json string")
    found = {(r.time.hour, r.time.minute, r.v) for r in text.header_rows(documents, ["v"], ["propagated_time_tag", "time_tag"]).collect()}
    assert found == {(0, 0, 1.0), (1, 0, 2.0)}
