"""The counter-based generator: known words, shapes of distributions, and the same draws whatever the partitions."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import draws
from plumbline.operators import shadow


def test_words_are_the_published_ones():
    assert [int(x) for x in draws.philox((0, 0, 0, 0), (0, 0))] == [0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]
    most = 0xFFFFFFFF
    assert [int(x) for x in draws.philox((most,) * 4, (most, most))] == [0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD]


def test_inverse_is_the_standard_librarys():
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 2001), 10.0 ** -np.arange(7, 300, 13)])
    assert draws.normal_inverse(p) == pytest.approx([statistics.NormalDist().inv_cdf(x) for x in p.tolist()], rel=1e-14, abs=1e-15)


def test_numbers_are_uniform_normal_and_within_bounds():
    w = draws.philox((np.arange(200_000), 3, 5, 7), (10, 77))
    u = np.sort(draws.uniform(w[0], w[1]))
    assert np.abs(u - (np.arange(len(u)) + 0.5) / len(u)).max() < 0.004
    for z in draws.normal_pair(w):
        assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs((np.abs(z) > 1.959964).mean() - 0.05) < 0.003
    x = draws.truncated_normal(u, 0.5, 0.4, 0.05, 2.0)
    assert x.min() > 0.05 and x.max() < 2 and (draws.truncated_normal(u[:3], 4.0, 0.0, 0.0, 1.0) == 4).all()


def test_propagation_is_the_same_in_any_partitions(spark):
    columns = "galaxy string, radius double, distance double, distance_error double, inclination double, inclination_error double, v_obs double, v_err double, v_gas double, v_disk double, v_bulge double"
    rows = [(f"G{i % 3}", float(i), 10.0, 0.5, 60.0 + i % 3, 2.0, 100.0 + i, 5.0, 20.0, 50.0, 1.0) for i in range(40)] + [("G1", 4.0, 10.0, 0.5, 61.0, 2.0, 104.0, 5.0, 20.0, 50.0, 1.0)]
    points = spark.createDataFrame(rows, columns)
    one, many = (sorted(map(tuple, shadow.propagate(points.repartition(n), 301).collect())) for n in (1, 7))
    assert one == many and len(one) == 41 and len(set(one)) == 40
    other = sorted(map(tuple, shadow.propagate(points, 301, point=F.col("radius") + 1).collect()))
    assert other != one and [r[:2] for r in other] == [r[:2] for r in one]
    assert all(np.all(np.diff(r[2:]) > 0) for r in one)


def test_propagation_uses_all_cores_and_draws_a_galaxy_once_for_its_rows(spark):
    columns = "galaxy string, radius double, distance double, distance_error double, inclination double, inclination_error double, v_obs double, v_err double, v_gas double, v_disk double, v_bulge double"
    rows = [(f"G{i % 3}", float(i), 10.0, 0.5, 60.0 + i % 3, 2.0, 100.0 + i, 5.0, 20.0, 50.0, 1.0) for i in range(240)]
    points = spark.createDataFrame(rows, columns).coalesce(1)  # one file's rows
    out = shadow.propagate(points, 16)
    assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    used = out.select("galaxy", F.spark_partition_id().alias("part")).distinct().collect()
    assert len({r.part for r in used}) > 4  # three galaxies keep more than three tasks busy
    assert len(used) <= 3 * shadow.PARTS  # and each is drawn for a few of them, whatever its rows' order
