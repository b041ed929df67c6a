"""Pairs on the sky, distances of a flat expanding universe, critical densities, spherical integrals."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.session import spread

#: The speed of light in km/s, gravity in Mpc (km/s)^2 / solar mass, and the default universe.
C_KM_S = 299792.458
G_MPC = 4.30091e-9
H0, OMEGA_M = 70.0, 0.3


def pairs_within(lenses: DataFrame, sources: DataFrame, degrees: float) -> DataFrame:
    """lens, source, ra_l, dec_l, ra_s, dec_s, degrees of all pairs that stand apart, but no more than the angle. lenses: lens, ra, dec;
    sources: source, ra, dec, in degrees, ra from 0 to 360, dec from -90 to 90.

    Sky cells no smaller than the angle make it an equi-join: a lens looks into the cells around its own, in a ring
    around the circle, as far in ra as the angle reaches at its declination; a lens from which it reaches a pole looks into whole rings.
    Cells are dealt into many tasks, as pairs may be many times the rows."""
    tasks = spread(lenses.sparkSession)
    rings = max(1, math.floor(360 / (1.001 * degrees)))
    wide = 360 / rings
    # how many cells of ra the angle can reach at a declination
    widest = F.degrees(F.asin(F.least(math.sin(math.radians(min(degrees, 90.0))) / F.cos(F.radians("dec")), F.lit(1.0)))) * 1.000001
    reach = F.when(F.abs("dec") + degrees < 90, F.least(F.ceil(widest / wide), F.lit(rings))).otherwise(rings).cast("int")
    cell = lambda c: F.floor(F.col(c) / wide).cast("int")
    steps = F.sequence(-reach, reach)
    # a ring that is reached around comes once
    xs = F.array_distinct(F.transform(steps, lambda i: F.pmod(cell("ra") + i, F.lit(rings))))
    ys = F.array(*[cell("dec") + i for i in (-1, 0, 1)])
    near = lenses.select("lens", F.col("ra").alias("ra_l"), F.col("dec").alias("dec_l"), F.explode(xs).alias("x"), ys.alias("ys"))
    near = near.select("lens", "ra_l", "dec_l", "x", F.explode("ys").alias("y"))
    there = sources.select("source", F.col("ra").alias("ra_s"), F.col("dec").alias("dec_s"), F.pmod(cell("ra"), F.lit(rings)).alias("x"), cell("dec").alias("y"))
    d = F.degrees(scalars.haversine(F.col("ra_l"), F.col("dec_l"), F.col("ra_s"), F.col("dec_s")))
    return near.repartition(tasks, "x", "y").join(there.repartition(tasks, "x", "y"), ["x", "y"]).withColumn("degrees", d).where((F.col("degrees") <= degrees) & (F.col("degrees") > 0)).drop("x", "y")


def expanded(pairs: DataFrame, lenses: DataFrame, sources: DataFrame, lens_kind: list[str], source_kind: list[str]) -> DataFrame:
    """Pairs of kinds as pairs of lenses and sources: each pair with every lens and every source whose columns of the kind are equal. What a pair is
    worth is so worked out once for rows alike; only their keys are written out for each. The three tables have no other columns in common."""
    tasks = spread(pairs.sparkSession)
    near = pairs.join(lenses, lens_kind).repartition(tasks, *source_kind)
    return near.join(sources.repartition(tasks, *source_kind), source_kind)


def comoving(z: Column, h0: float = H0, omega_m: float = OMEGA_M, steps: int = 64) -> Column:
    """Mpc to a redshift, by Simpson's rule on an even number of steps: the integral of c / H. Null below 0."""
    f = lambda k: 1 / F.sqrt(omega_m * F.pow(1 + z * k / steps, 3) + 1 - omega_m)
    weight = lambda k: F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, k: a + weight(k) * f(k))
    return F.when(z >= 0, total * z / steps / 3 * C_KM_S / h0)


def angular_diameter(z: Column, comoving_mpc: Column) -> Column:
    return comoving_mpc / (1 + z)


def angular_diameter_between(z_near: Column, z_far: Column, near_mpc: Column, far_mpc: Column) -> Column:
    """Mpc, from comoving distances; 0 where the far one is not behind."""
    return F.when(z_far > z_near, (far_mpc - near_mpc) / (1 + z_far)).otherwise(0.0)


def critical_density(df: DataFrame, z_lens: str, z_source: str, out: str = "sigma_critical") -> DataFrame:
    """df with solar masses / Mpc^2; infinite where a redshift is no number, the source is not behind, or a distance is 0. Distances are
    worked out once for each distinct redshift and joined back."""
    zs = df.select(F.col(z_lens).cast("double").alias("z")).unionByName(df.select(F.col(z_source).cast("double").alias("z")))
    known = zs.where("z >= 0 AND z < double('Infinity') AND NOT isnan(z)").distinct().withColumn("d", comoving(F.col("z")))
    side = lambda c, n: known.select(F.col("z").alias(c), F.col("d").alias(n))
    both = df.withColumn("__zl", F.col(z_lens).cast("double")).withColumn("__zs", F.col(z_source).cast("double"))
    both = both.join(side("__zl", "__dl"), "__zl", "left").join(side("__zs", "__ds"), "__zs", "left")
    zl, zs_, dl, ds = (F.col(c) for c in ("__zl", "__zs", "__dl", "__ds"))
    near, far, between = angular_diameter(zl, dl), angular_diameter(zs_, ds), angular_diameter_between(zl, zs_, dl, ds)
    value = C_KM_S**2 / (4 * math.pi * G_MPC) * far / F.nullif(near * between, F.lit(0.0))
    fine = dl.isNotNull() & ds.isNotNull() & (between > 0) & (near > 0)
    return both.withColumn(out, F.when(fine, value).otherwise(float("inf"))).drop("__zl", "__zs", "__dl", "__ds")


def spherical_deprojection(r: Column, profile: Callable[[Column], Column], points: int = 4096) -> Column:
    """4 times the integral of profile(r / sin t) for t from 1e-8 to a quarter turn, by trapezoids; with G and the profile's units it is
    an acceleration."""
    step = (math.pi / 2 - 1e-8) / points
    at = lambda k: profile(r / F.sin(1e-8 + step * k))
    weight = lambda k: F.when((k == 0) | (k == points), 0.5).otherwise(1.0)
    return 4 * step * F.aggregate(F.sequence(F.lit(0), F.lit(points)), F.lit(0.0), lambda a, k: a + weight(k) * at(k))
