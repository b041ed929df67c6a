"""Exact quantiles by passes, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordered, robust, selection

SHARES = [0.0, 0.16, 0.161, 0.5, 0.84, 1.0]


def found(df, by=("g",), small=50, shares=SHARES):
    return {tuple(r[c] for c in by): (r.n, r.q) for r in selection.quantiles(df, list(by), "v", shares, small).collect()}


def test_passes_give_numpys_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.normal(size=5001), "wide": np.exp(rng.normal(size=4000) * 80) * rng.choice([-1, 1], 4000), "ties": rng.choice([1.0, 2.0, 7.5], 3000, p=[0.49, 0.02, 0.49]),
        "one value": np.full(500, 3.25), "few": rng.normal(size=7), "edge": np.r_[np.full(2000, -1.0), rng.normal(size=60), np.full(2000, 9.0)], None: rng.normal(size=300),
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("few", None), ("few", float("nan")), ("nothing", None), ("wide", None)]
    got = found(spark.createDataFrame(rows, "g string, v double").repartition(5))
    assert set(got) == {(k,) for k in groups}
    for k, xs in groups.items():
        n, q = got[(k,)]
        assert n == len(xs)
        assert q == pytest.approx(np.quantile(xs, SHARES), rel=1e-12), k


def test_ranks_that_the_sketch_misses_are_still_exact(spark, monkeypatch):
    monkeypatch.setattr(selection, "ACCURACY", 40)  # a sketch that is far off
    rng = np.random.default_rng(2)
    xs = rng.pareto(0.3, 3000)
    got = found(spark.createDataFrame([("a", float(x)) for x in xs], "g string, v double"), small=20)
    assert got[("a",)][1] == pytest.approx(np.quantile(xs, SHARES), rel=1e-12)


def test_no_key_and_no_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert selection.quantiles(df, [], "v", [0.5], 10).first().q == [499.5]
    assert selection.quantiles(df.where("v < 0").withColumn("g", F.lit(1)), ["g"], "v", [0.5]).count() == 0


def test_a_group_of_ten_million_values_passes_through_bounded_buffers(spark):
    """Distinct values of one group; none of the aggregations holds more than a sketch or `small` of them."""
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select(F.lit(1).alias("g"), (F.pmod(F.col("id") * 7_368_787, F.lit(n)) / 4.0).alias("v"))
    got = found(df, small=20_000, shares=[0.25, 0.5])
    assert got[(1,)] == (n, [(n - 1) * 0.25 / 4, (n - 1) * 0.5 / 4])


def test_summary_and_scale_take_passes_too(spark, monkeypatch):
    rng = np.random.default_rng(3)
    xs = rng.normal(size=900)
    df = spark.createDataFrame([("a", float(x)) for x in xs], "g string, v double")
    plain = robust.residual_summary(df, "g", "v").first()
    monkeypatch.setattr(robust, "medians", lambda *a: selection.medians(*a, *([] if len(a) > 3 else ["median"]), small=100))
    assert robust.residual_summary(df, "g", "v").first() == plain
    assert plain.median == pytest.approx(np.median(xs)) and plain.mad == pytest.approx(np.median(abs(xs - np.median(xs))))


def _counted(spark, rows):
    """rows, and an accumulator of how many of them were computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    return rows.mapInPandas(run, rows.schema), seen


def test_passes_read_values_that_were_written_once(spark):
    rows, seen = _counted(spark, spark.range(6000).selectExpr("id % 2 AS k", "double(id * 7919 % 6007) AS v"))
    found = {r.k: r.q for r in selection.quantiles(rows, ["k"], "v", [0.1, 0.5], small=50).collect()}
    assert seen.value <= 2 * 6000  # one count, one table
    for k in (0, 1):
        assert found[k] == pytest.approx(np.quantile([float(i * 7919 % 6007) for i in range(k, 6000, 2)], [0.1, 0.5]).tolist())


def test_a_summary_computes_its_input_twice(spark):
    rows, seen = _counted(spark, spark.range(3000).selectExpr("id % 2 AS k", "double(id * 7919 % 6007) AS v"))
    assert robust.residual_summary(rows, "k", "v").count() == 2
    assert seen.value <= 2 * 3000  # one table for the medians, one pass of sums


def test_a_cadence_computes_its_steps_once(spark):
    table = spark.range(3000).selectExpr("id % 2 AS k", "double(id * id) AS t", "id")
    rows, seen = _counted(spark, table)
    ordered.first_difference(rows, ["k"], ["t", "id"], "t").write.format("noop").mode("overwrite").save()
    once = seen.value
    rows, seen = _counted(spark, table)
    assert ordered.cadence(rows, "k", ["t", "id"]).count() == 2
    assert seen.value <= once
