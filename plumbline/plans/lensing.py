"""Sky pairs, critical densities, deprojection and plane waves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import lens, network, sky
from plumbline.session import saved


def _sky(spark, sf_dir, table, key):
    """ra and dec in degrees, from a key alone: a band ten degrees high."""
    k = F.col(key)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(k.alias("id"), (k * 37 % 3600 / 10.0).alias("ra"), (k * 53 % 100 / 10.0).alias("dec"))


def haversine_rotation_pairs(spark, sf_dir):
    """Suppliers and customers within 1.5 degrees, with their separation and rotated shear, which are worked out once for all that stand at one
    place with one ellipticity."""
    lenses = _sky(spark, sf_dir, "supplier", "s_suppkey").select(F.col("id").alias("lens"), F.col("ra").alias("ra_l"), F.col("dec").alias("dec_l"))
    k = F.col("id")
    sources = _sky(spark, sf_dir, "customer", "c_custkey").select(k.alias("source"), F.col("ra").alias("ra_s"), F.col("dec").alias("dec_s"), (k % 7 / 10.0).alias("e1"), (k % 5 / 10.0).alias("e2"))
    at = lambda df, side: df.select(F.col(f"ra_{side}").alias("ra"), F.col(f"dec_{side}").alias("dec")).distinct()
    place = F.struct("ra", "dec")
    places = sky.pairs_within(at(lenses, "l").withColumn("lens", place), at(sources, "s").withColumn("source", place), 1.5).drop("lens", "source")
    kinds = places.join(sources.drop("source").distinct(), ["ra_s", "dec_s"])
    tangential, cross = scalars.rotate_shear(F.col("e1"), F.col("e2"), F.col("ra_l"), F.col("dec_l"), F.col("ra_s"), F.col("dec_s"))
    # written once, so that what is worked out stays before the copies of each row
    pairs = saved(kinds.select("ra_l", "dec_l", "ra_s", "dec_s", "e1", "e2", F.round("degrees", 6).alias("degrees"), (F.round(tangential, 6) + 0.0).alias("tangential"), (F.round(cross, 6) + 0.0).alias("cross_part")), "pairs-of-kinds")
    out = sky.expanded(pairs, lenses, sources, ["ra_l", "dec_l"], ["ra_s", "dec_s", "e1", "e2"])
    return out.select("lens", "source", "degrees", "tangential", "cross_part")


def critical_density(spark, sf_dir):
    """Critical surface densities in 1e15 solar masses / Mpc^2 for redshifts from keys; null where infinite."""
    k = F.col("c_custkey")
    zs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), (k % 20 / 50.0).alias("zl"), F.when(k % 41 > 0, k % 31 / 20.0 + 0.11).alias("zs"))
    out = sky.critical_density(zs, "zl", "zs")
    finite = F.col("sigma_critical") < float("inf")
    return out.select("id", finite.alias("behind"), F.when(finite, F.round(F.col("sigma_critical") / 1e15, 6)).alias("sigma"))


def distances(spark, sf_dir):
    """Comoving and angular distances in Mpc of redshifts from keys, and between neighbours."""
    k = F.col("s_suppkey")
    z = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (k % 40 / 20.0).alias("z"), (k % 23 / 10.0).alias("far"))
    z = z.withColumn("d", sky.comoving(F.col("z"))).withColumn("e", sky.comoving(F.col("far")))
    between = sky.angular_diameter_between(F.col("z"), F.col("far"), F.col("d"), F.col("e"))
    return z.select("s_suppkey", F.round("d", 5).alias("comoving"), F.round(sky.angular_diameter(F.col("z"), F.col("d")), 5).alias("angular"), F.round(between, 5).alias("between"))


def spherical_deprojection(spark, sf_dir):
    """The integral over the sphere of each supplier's own profile, of six shapes, at a radius of its own, by 256 trapezoids; some
    radii lie beyond the profile's ends."""
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    radius = F.pow(F.lit(10.0), F.col("b") / 4.0 - 1.5)
    value = (1 + k % 7) * F.pow(radius, -(0.5 + k % 3 / 2.0)) * F.exp(-(k % 2) * F.col("b") * F.col("b") / 20.0)
    knots = lens.profile_knots(s.select(k, radius.alias("radius"), value.alias("esd")), "s_suppkey")
    r = 0.01 * F.pow(F.lit(2.0), k % 11)
    return knots.select(k, F.round(sky.spherical_deprojection(r, lambda q: lens.log_log(F.col("knots"), q, -1.0, -2.0), 256), 6).alias("g"))


def plane_wave_surface(spark, sf_dir):
    """Nations modulo five as nodes, their suppliers' balances by key modulo ten as readings: the best centre of each of eight waves
    of given delays."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 5).alias("node"), "s_acctbal")
    grid = s.groupBy("node", (F.col("k") % 10).cast("long").alias("k")).agg(F.avg("s_acctbal").cast("double").alias("z"))
    nodes = s.select("node").distinct()
    delay = nodes.select("node", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("template")).withColumn("delay", F.col("node") * F.col("template") / 4.0)
    scores = network.surface(grid, delay, nodes.withColumn("w", F.lit(1.0)))
    return network.best_hit(scores, ("template",), digits=4).select("template", "centre", F.round("score", 4).alias("score"))


def object_level_stack(spark, sf_dir):
    """Suppliers as lenses with falling profiles: each deprojected, then stacked at three accelerations (in units of 1e-13)."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    radii = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.pow(F.lit(10.0), k / 4.0 - 1.5))
    profiles = s.select(F.col("s_suppkey").alias("lens"), F.explode(radii).alias("radius"))
    profiles = profiles.withColumn("esd", 1e12 * (1 + F.col("lens") % 7) / F.col("radius"))
    masses = s.select(F.col("s_suppkey").alias("lens"), (1e10 * (1 + F.col("s_suppkey") % 5)).alias("mass"))
    out = lens.stack(lens.deproject_lenses(profiles, masses, [1e-12, 1e-11, 1e-10], -1.0, -1.0, 1024))
    return out.select(F.round(F.log10("gbar"), 6).alias("log_gbar"), F.round(F.col("gobs") * 1e13, 6).alias("gobs"), "lenses")


NODES = 64
BINS = 12


def _radii(spark, sf_dir):
    """Nations as profiles, their customers' keys modulo twelve as bins, a nation's radii on a scale of its own."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % BINS).alias("b")).distinct()
    place = F.row_number().over(Window.partitionBy("nation").orderBy("b")) - 1  # a row a bin
    return c.select("nation", place.alias("i"), ((F.col("b") + 1) * (F.col("b") + 2) * (20 + F.col("nation")) / 1024.0).alias("radius"))


def deprojection_matrix(spark, sf_dir):
    """The integral's matrix for linear interpolation over each nation's radii and each of three tails."""
    radii, out = _radii(spark, sf_dir), None
    for tail in ("flat", "sis", "zero"):
        m = lens.deprojection_operators(radii, "nation", NODES, tail=tail).select("nation", F.lit(tail).alias("tail"), "i", "j", (F.round("v", 8) + 0.0).alias("v"))
        out = m if out is None else out.unionByName(m)
    return out


def deprojection_matrix_quadratic(spark, sf_dir):
    """The same for quadratic splines, as what it makes of the profiles 1, R and R^2 where no tail is needed: the first row's sums.
    A spline of degree two keeps them, so they are closed integrals by the same nodes."""
    radii = _radii(spark, sf_dir)
    m = lens.deprojection_operators(radii, "nation", NODES, interpolation="quadratic", tail="zero")
    both = m.join(radii.withColumnRenamed("i", "j"), ["nation", "j"])
    return both.groupBy("nation", "i").agg(*[F.round(F.sum(F.col("v") * F.pow("radius", F.lit(float(p)))), 5).alias(f"p{p}") for p in range(3)])


PLANS = [haversine_rotation_pairs, critical_density, distances, spherical_deprojection, plane_wave_surface, object_level_stack, deprojection_matrix, deprojection_matrix_quadratic]

_D = "sum(CASE WHEN k = 0 OR k = 64 THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END::DOUBLE / sqrt(0.3::DOUBLE * (1 + {0} * k / 64) ** 3 + 1 - 0.3::DOUBLE)) * {0} / 64 / 3 * 299792.458::DOUBLE / 70"
#: Gauss and Legendre's places as angles of a quarter turn, and their weights.
_AT, _WEIGHT = ((x * np.pi / 4).tolist() for x in (lambda at, w: (at + 1, w))(*np.polynomial.legendre.leggauss(NODES)))
_NODES = f"""x0 AS (SELECT DISTINCT c_nationkey AS nation, c_custkey % {BINS} AS b FROM customer), x1 AS (SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY b) - 1 AS i, (b + 1) * (b + 2) * (20 + nation) / 1024.0::DOUBLE AS x, count(*) OVER (PARTITION BY nation) AS n FROM x0),
 x AS (SELECT * FROM x1 WHERE n >= 3), q AS (SELECT x.nation, x.i, x.x / sin(a) AS q, w FROM x, (SELECT unnest({_AT}::DOUBLE[]) AS a, unnest({_WEIGHT}::DOUBLE[]) AS w))"""
SQL = {
    "haversine_rotation_pairs": """WITH l AS (SELECT s_suppkey AS lens, (s_suppkey * 37 % 3600) / 10.0::DOUBLE AS ra, (s_suppkey * 53 % 100) / 10.0::DOUBLE AS dec FROM supplier),
 s AS (SELECT c_custkey AS source, (c_custkey * 37 % 3600) / 10.0::DOUBLE AS ra, (c_custkey * 53 % 100) / 10.0::DOUBLE AS dec, (c_custkey % 7) / 10.0::DOUBLE AS e1, (c_custkey % 5) / 10.0::DOUBLE AS e2 FROM customer),
 p AS (SELECT lens, source, e1, e2, degrees(2 * asin(least(1.0, sqrt(sin(radians(s.dec - l.dec) / 2) ** 2 + cos(radians(l.dec)) * cos(radians(s.dec)) * sin(radians(s.ra - l.ra) / 2) ** 2)))) AS d,
       atan2(s.dec - l.dec, (s.ra - l.ra - CASE WHEN s.ra - l.ra > 180 THEN 360 WHEN s.ra - l.ra < -180 THEN -360 ELSE 0 END) * cos(radians(l.dec))) AS a FROM l, s WHERE (abs(l.ra - s.ra) < 3.2 OR abs(l.ra - s.ra) > 356.8) AND abs(l.dec - s.dec) < 3.2)
 SELECT lens, source, round(d, 6) AS degrees, round(-(e1 * cos(2 * a) + e2 * sin(2 * a)), 6) + 0.0 AS tangential, round(e1 * sin(2 * a) - e2 * cos(2 * a), 6) + 0.0 AS cross_part FROM p WHERE d <= 1.5 AND d > 0""",
    "critical_density": f"""WITH z AS (SELECT c_custkey AS id, (c_custkey % 20) / 50.0::DOUBLE AS zl, CASE WHEN c_custkey % 41 > 0 THEN (c_custkey % 31) / 20.0::DOUBLE + 0.11::DOUBLE END AS zs FROM customer), k AS (SELECT unnest(range(0, 65)) AS k),
 d AS (SELECT zl, zs, {_D.format("zl")} AS dl, {_D.format("zs")} AS ds FROM (SELECT DISTINCT zl, zs FROM z WHERE zs IS NOT NULL), k GROUP BY zl, zs)
 SELECT id, coalesce(zs > zl AND zl > 0, false) AS behind, round(CASE WHEN zs > zl AND zl > 0 THEN 299792.458::DOUBLE ** 2 / (4 * pi() * 4.30091e-9::DOUBLE) * (ds / (1 + zs)) / (dl / (1 + zl) * (ds - dl) / (1 + zs)) / 1e15::DOUBLE END, 6) AS sigma FROM z LEFT JOIN d USING (zl, zs)""",
    "distances": f"""WITH z AS (SELECT s_suppkey, (s_suppkey % 40) / 20.0::DOUBLE AS z, (s_suppkey % 23) / 10.0::DOUBLE AS y FROM supplier), k AS (SELECT unnest(range(0, 65)) AS k),
 d AS (SELECT s_suppkey, z, y, {_D.format("z")} AS d, {_D.format("y")} AS e FROM z, k GROUP BY s_suppkey, z, y)
 SELECT s_suppkey, round(d, 5) AS comoving, round(d / (1 + z), 5) AS angular, round(CASE WHEN y > z THEN (e - d) / (1 + y) ELSE 0 END, 5) AS between FROM d""",
    "object_level_stack": """WITH k AS (SELECT unnest(range(0, 1024)) AS k), t AS (SELECT sum(CASE WHEN k = 0 OR k = 1023 THEN 0.5 ELSE 1.0 END::DOUBLE * sin(1e-8 + (pi() / 2 - 1e-8) * k / 1023)) * (pi() / 2 - 1e-8) / 1023 AS t FROM k),
 g AS (SELECT unnest([1e-12, 1e-11, 1e-10]::DOUBLE[]) AS g),
 l AS (SELECT g, 1e12::DOUBLE * (1 + s_suppkey % 7) * t / (sqrt(6.67430e-11::DOUBLE * 1e10::DOUBLE * (1 + s_suppkey % 5) * 1.98847e30::DOUBLE / g) / 3.085677581491367e22::DOUBLE) AS i FROM supplier, t, g)
 SELECT round(log10(g), 6) AS log_gbar, round(avg(4 * 4.30091e-9::DOUBLE * i * 1e6::DOUBLE / 3.085677581491367e22::DOUBLE) * 1e13::DOUBLE, 6) AS gobs, count(*) AS lenses FROM l GROUP BY g""",
    "deprojection_matrix": f"""WITH {_NODES}, m AS (SELECT nation, max(x) AS m, max(i) AS last FROM x GROUP BY 1), b AS (SELECT a.nation, a.i AS lo, a.x AS a, b.x AS b FROM x a JOIN x b ON b.nation = a.nation AND b.i = a.i + 1), t AS (SELECT unnest(['flat', 'sis', 'zero']) AS tail),
 p AS (SELECT nation, tail, i, lo AS j, w * (b - q) / (b - a) AS v FROM q JOIN b USING (nation) JOIN m USING (nation), t WHERE q <= m AND q >= a AND (q < b OR (q = b AND b = m)) UNION ALL
       SELECT nation, tail, i, lo + 1, w * (q - a) / (b - a) FROM q JOIN b USING (nation) JOIN m USING (nation), t WHERE q <= m AND q >= a AND (q < b OR (q = b AND b = m)) UNION ALL
       SELECT nation, tail, i, last, w * CASE tail WHEN 'sis' THEN m / q WHEN 'flat' THEN 1 ELSE 0 END FROM q JOIN m USING (nation), t WHERE q > m UNION ALL SELECT a.nation, tail, a.i, b.i, 0 FROM x a JOIN x b USING (nation), t)
 SELECT nation, tail, i::INTEGER AS i, j::INTEGER AS j, round(sum(v), 8) + 0.0 AS v FROM p GROUP BY ALL""",
    "deprojection_matrix_quadratic": f"""WITH {_NODES}, m AS (SELECT nation, max(x) AS m FROM x GROUP BY 1) SELECT nation, i::INTEGER AS i, round(coalesce(sum(w) FILTER (q <= m), 0), 5) AS p0, round(coalesce(sum(w * q) FILTER (q <= m), 0), 5) AS p1, round(coalesce(sum(w * q * q) FILTER (q <= m), 0), 5) AS p2 FROM q JOIN m USING (nation) GROUP BY 1, 2""",
    "spherical_deprojection": """WITH s AS (SELECT s_suppkey AS k, 0.01::DOUBLE * 2.0::DOUBLE ** (s_suppkey % 11) AS r FROM supplier), b AS (SELECT unnest(range(0, 8)) AS b),
 n AS (SELECT k, b, (b / 4.0::DOUBLE - 1.5) * ln(10::DOUBLE) AS x, ln((1 + k % 7)::DOUBLE) - (0.5::DOUBLE + (k % 3) / 2.0::DOUBLE) * (b / 4.0::DOUBLE - 1.5) * ln(10::DOUBLE) - (k % 2) * b * b / 20.0::DOUBLE AS y FROM s, b),
 a AS (SELECT k, p, ln(r / sin(1e-8::DOUBLE + (pi() / 2 - 1e-8::DOUBLE) * p / 256)) AS q FROM s, (SELECT unnest(range(0, 257)) AS p)),
 e AS (SELECT k, min(x) AS x0, max(x) AS x1, max(y) FILTER (b = 0) AS y0, max(y) FILTER (b = 7) AS y1 FROM n GROUP BY k),
 v AS (SELECT a.k, p, CASE WHEN q < x0 THEN y0 - (q - x0) WHEN q > x1 THEN y1 - 2 * (q - x1) ELSE (SELECT max(l.y + (h.y - l.y) * (q - l.x) / (h.x - l.x)) FROM n l JOIN n h ON h.k = l.k AND h.b = l.b + 1 WHERE l.k = a.k AND q >= l.x AND q <= h.x) END AS y FROM a JOIN e USING (k))
 SELECT k AS s_suppkey, round(4 * sum(CASE WHEN p = 0 OR p = 256 THEN 0.5 ELSE 1.0 END::DOUBLE * exp(y)) * (pi() / 2 - 1e-8::DOUBLE) / 256, 6) AS g FROM v GROUP BY k""",
    "plane_wave_surface": """WITH g AS (SELECT s_nationkey % 5 AS node, (s_suppkey % 10)::BIGINT AS k, avg(s_acctbal) AS v FROM supplier GROUP BY ALL), w AS (SELECT unnest(range(1, 9))::INTEGER AS template),
 d AS (SELECT DISTINCT node, template, node * template / 4.0::DOUBLE AS d FROM g, w),
 s AS (SELECT template, a.k - floor(d)::BIGINT AS centre, a.v * (1 - (d - floor(d))) + b.v * (d - floor(d)) AS s FROM d JOIN g a USING (node) JOIN g b ON b.node = a.node AND b.k = a.k + 1),
 t AS (SELECT template, centre, sum(s) AS score FROM s GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT node) FROM g)),
 b AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY abs(round(score, 4)) DESC, centre) AS i FROM t) SELECT template, centre, round(score, 4) AS score FROM b WHERE i = 1""",
}
