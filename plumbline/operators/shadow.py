"""Rotation-curve selection, Monte-Carlo propagation, lens accumulation, shrinkage covariance."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import draws as generator
from plumbline.functions import scalars
from plumbline.session import saved

#: Mean, deviation and bounds of the mass-to-light ratios of disk and bulge, and the bounds of the distance's
#: scale and of the inclination in degrees.
DISK = (0.5, 0.1, 0.05, 2.0)
BULGE = (0.7, 0.15, 0.05, 2.0)
SCALE_BOUNDS = (0.1, 10.0)
INCLINATION_BOUNDS = (5.0, 90.0)
#: The quantiles that a propagation gives, the points whose draws a task holds at a time, the parts that a galaxy's points are dealt into, and
#: how many partitions a core gets.
SHARES = (0.025, 0.16, 0.5, 0.84, 0.975)
POINTS = 8
PARTS = 8
WAVES = 4


def select_observations(models: DataFrame, sample: DataFrame) -> DataFrame:
    """Radii of galaxies of quality 2 or better, inclination 30 or more, positive radius, speed and error, and a relative error of
    a tenth at most, with the galaxy's columns."""
    both = models.join(sample.drop("distance"), "galaxy")
    return both.where("quality <= 2 AND inclination >= 30 AND radius > 0 AND v_obs > 0 AND v_err > 0 AND v_err / abs(v_obs) <= 0.10")


def nominal(points: DataFrame, disk: float = DISK[0], bulge: float = BULGE[0]) -> DataFrame:
    """points with v_bar2 (signed squares of gas, disk and bulge), delta_v2 and closure cost."""
    bar = scalars.signed_square(F.col("v_gas")) + disk * scalars.signed_square(F.col("v_disk")) + bulge * scalars.signed_square(F.col("v_bulge"))
    out = points.withColumn("v_bar2", bar).withColumn("delta_v2", F.pow("v_obs", F.lit(2)) - F.col("v_bar2"))
    return out.withColumn("closure_cost", F.abs(F.col("v_obs") - F.sqrt(F.greatest("v_bar2", F.lit(0.0)))) / F.col("v_err"))


def propagate(points: DataFrame, draws: int = 4096, seed: int = 10, point: Column | None = None) -> DataFrame:
    """galaxy, radius and quantiles (2.5, 16, 50, 84, 97.5 %) of delta_v2 for every row of points, over draws of distance, inclination and
    mass-to-light (one a galaxy) and speed (one a point). Truncated normals; an error where their bounds leave nothing.

    Draws come from counters: the key is seed and the first 32 bits of the name's MD5, the counter (draw, stream, point), so that rows
    are independent, in whatever task. point: an integer that tells a galaxy's points apart (none: a hash of the radius); points alike in it
    draw alike. A galaxy's own draws are made once for each run of its rows, so rows are dealt by galaxy and part of its points, and put in order
    there: a few numbers a point are shuffled, all cores draw however few files the points come from, and a galaxy of many points is PARTS tasks'
    work. A task holds some points' draws at a time."""
    names = ["q025", "q16", "q50", "q84", "q975"]
    number = (point if point is not None else F.xxhash64("radius")).cast("long")
    key = F.conv(F.substring(F.md5(F.col("galaxy").cast("binary")), 1, 8), 16, 10).cast("long")
    own = ["key", "distance", "distance_error", "inclination", "inclination_error"]
    rows = points.select("galaxy", "radius", key.alias("key"), number.alias("point"), "distance", "distance_error", "inclination", "inclination_error", "v_obs", "v_err", "v_gas", "v_disk", "v_bulge")
    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), WAVES * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, "galaxy", F.pmod(F.xxhash64("point"), F.lit(PARTS))).sortWithinPartitions("galaxy", *own)
    square = lambda v: v * np.abs(v)

    def of_galaxy(name: int, distance: float, distance_error: float, inclination: float, inclination_error: float) -> tuple[np.ndarray, ...]:
        """Scale, disk, bulge and what the inclination does to a speed, for each draw."""
        first, second = (generator.philox((np.arange(draws), stream, 0, 0), (seed, int(name))) for stream in (0, 1))
        u = [generator.uniform(w[i], w[i + 1]) for w in (first, second) for i in (0, 2)]
        scale = generator.truncated_normal(u[0], 1.0, distance_error / distance, *SCALE_BOUNDS)
        incline = generator.truncated_normal(u[1], inclination, inclination_error, *INCLINATION_BOUNDS)
        disk, bulge = generator.truncated_normal(u[2], *DISK), generator.truncated_normal(u[3], *BULGE)
        return scale, scale * disk, scale * bulge, np.sin(np.radians(inclination)) / np.sin(np.radians(incline))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_share = (draws - 1) * np.array(SHARES)
        low, high, part = np.floor(at_share).astype(int), np.ceil(at_share).astype(int), at_share % 1
        counters = np.arange(-(-draws // 2))[None]
        last = None
        for f in frames:
            if not len(f):
                continue
            of = f[own].to_numpy(float, na_value=np.nan)
            keys, at = f.key.to_numpy(np.int64), f.point.to_numpy(np.int64).view(np.uint64)[:, None]
            speed, error = (f[c].to_numpy(float)[:, None] for c in ("v_obs", "v_err"))
            gas, disk, bulge = (square(f[c].to_numpy(float)[:, None]) for c in ("v_gas", "v_disk", "v_bulge"))
            found = np.empty((len(f), len(names)))
            starts = np.r_[0, np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1, len(f)]
            for a, b in zip(starts[:-1], starts[1:]):
                if last is None or not np.array_equal(last[0], of[a]):
                    last = of[a].copy(), of_galaxy(keys[a], *of[a, 1:])
                scale, scaled_disk, scaled_bulge, tilt = last[1]
                for i in range(a, b, POINTS):
                    p = slice(i, min(i + POINTS, b))
                    pair = generator.philox((counters, 2, at[p] & np.uint64(0xFFFFFFFF), at[p] >> np.uint64(32)), (seed, int(keys[a])))
                    z = np.stack(generator.normal_pair(pair), 2).reshape(len(at[p]), -1)[:, :draws]
                    x = z * error[p]
                    x += speed[p]
                    x *= tilt
                    x *= x
                    for ours, theirs in ((scale, gas), (scaled_disk, disk), (scaled_bulge, bulge)):
                        x -= ours * theirs[p]
                    x.sort(axis=1)  # quicker than selection for some thousand draws
                    found[p] = x[:, low] + (x[:, high] - x[:, low]) * part
            yield pd.DataFrame({"galaxy": f.galaxy, "radius": f.radius} | dict(zip(names, found.T)))

    return rows.mapInPandas(run, "galaxy string, radius double, " + ", ".join(f"{n} double" for n in names))


def accumulate_esd(pairs: DataFrame, edges: list[float], lenses: int | None = None) -> DataFrame:
    """lens, bin, esd, cross_esd and pairs over all lens by bin cells (empty: null): weighted sums over inverse squared critical
    densities, with (1 + m) in the denominator. Bins are closed below and open above. Pairs with shears, weights or biases that are
    no numbers do not count; with `lenses`, indices beyond 0 to lenses - 1 do not either."""
    if lenses is not None:
        pairs = pairs.where(F.col("lens_index").between(0, lenses - 1))
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = pairs.where(number("tangential") & number("cross") & number("source_weight") & number("multiplicative_bias"))
    ok = ok.where("source_weight > 0 AND sigma_critical > 0 AND sigma_critical < double('Infinity') AND 1 + multiplicative_bias > 0")
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("projected_radius_mpc"))) - 1
    cells = ok.withColumn("bin", place).where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    w = F.col("source_weight") / F.pow("sigma_critical", F.lit(2))
    sums = cells.groupBy("lens_index", "bin").agg(F.sum(w * F.col("sigma_critical") * F.col("tangential")).alias("t"), F.sum(w * F.col("sigma_critical") * F.col("cross")).alias("x"), F.sum(w * (1 + F.col("multiplicative_bias"))).alias("d"), F.count("*").alias("n"))
    grid = pairs.select("lens_index").distinct().select("lens_index", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))).alias("bin"))
    return grid.join(sums, ["lens_index", "bin"], "left").select("lens_index", "bin", (F.col("t") / F.col("d")).alias("esd"), (F.col("x") / F.col("d")).alias("cross_esd"), F.coalesce("n", F.lit(0)).alias("pairs"))


#: Columns that a row of sums holds, and numbers of a task's strip of the matrix.
WIDE, HELD = 64, 1 << 24


def shrink_vectors(df: DataFrame, vector: str, size: int) -> DataFrame:
    """i, j, v and shrinkage: the shrunk covariance of all vectors of `size` components (an array column), whatever their number. Vectors of another
    length, and those with a null or a component that is not finite, are left out; none left: no rows.

    Tasks multiply their batches as matrices, in strips of HELD numbers (a pass over the vectors for each strip: one up to 4,096
    components), and send WIDE columns a row, which Spark sums with its own aggregation. The driver sees the means and three
    totals. Passes run when this is called."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    rows = df.select(F.col(vector).cast("array<double>").alias("x")).where((F.size("x") == size) & F.forall("x", finite))
    names = [f"c{k}" for k in range(WIDE)]
    blocks = -(-size // WIDE)
    schema = "i int, b int, " + ", ".join(f"{c} double" for c in names)
    sums = [F.sum(c).alias(c) for c in names]

    def frame(i, b: int, values: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(values, columns=names)
        out.insert(0, "b", b)
        out.insert(0, "i", i)
        return out

    def totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(blocks * WIDE)
        n = 0
        for f in frames:
            if len(f):
                held[:size] += np.stack(f.x).sum(0)
                n += len(f)
        if n:
            yield frame(-1, -1, np.r_[n, np.zeros(WIDE - 1)][None])
            for b, part in enumerate(held.reshape(blocks, WIDE)):
                yield frame(0, b, part[None])

    found = {r.b: np.array(r[2:]) for r in rows.mapInPandas(totals, schema).groupBy("i", "b").agg(*sums).collect()}
    n = int(found[-1][0]) if found else 0
    mean = np.concatenate([found[b] for b in range(blocks)])[:size] / n if n else np.zeros(size)

    def products(low: int, high: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, fourth = np.zeros((high - low, blocks * WIDE)), 0.0
            for f in frames:
                if len(f):
                    x = np.stack(f.x) - mean
                    held[:, low:size] += x[:, low:high].T @ x[:, low:]
                    fourth += ((x * x).sum(1) ** 2).sum() if low == 0 else 0.0
            if low == 0:
                yield frame(-1, -1, np.r_[fourth, np.zeros(WIDE - 1)][None])
            for b in range(low // WIDE, blocks):  # cells on and above the diagonal
                last = min(high, (b + 1) * WIDE)
                yield frame(np.arange(low, last), b, held[: last - low, b * WIDE : (b + 1) * WIDE])

        return run

    height = max(WIDE, HELD // size // WIDE * WIDE)
    parts = [rows.mapInPandas(products(low, min(low + height, size)), schema) for low in range(0, size, height)]
    # both of what follows read these
    table = saved(functools.reduce(DataFrame.union, parts).groupBy("i", "b").agg(*sums), "moments")
    cells = table.where("i >= 0").select("i", "b", F.posexplode(F.array(*names)).alias("k", "v"))
    cells = cells.select("i", (F.col("b") * WIDE + F.col("k")).alias("j"), (F.col("v") / max(n, 1)).alias("v")).where(f"j >= i AND j < {size} AND {n} > 0")
    trace, square = cells.agg(F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), F.lit(0.0)), F.coalesce(F.sum(F.col("v") * F.col("v") * F.when(F.col("i") == F.col("j"), 1).otherwise(2)), F.lit(0.0))).first()
    fourth = (table.where("i = -1").select("c0").first() or [0.0])[0] / max(n, 1)
    mu = trace / size
    d2 = (square - size * mu * mu) / size
    shrinkage = 0.0 if d2 <= 0 else min((fourth - square) / size / n, d2) / d2
    both = cells.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("c"), "v")
    return both.select("c.i", "c.j", ((1 - shrinkage) * F.col("v") + F.when(F.col("c.i") == F.col("c.j"), shrinkage * mu).otherwise(0.0)).alias("v"), F.lit(float(shrinkage)).alias("shrinkage"))


def ledoit_wolf(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, float]:
    """The shrunk covariance of complete rows and the shrinkage. Moments are Spark sums (a few numbers for each pair of columns,
    columns being few by contract); the formula is solved from them on the driver."""
    p = len(columns)
    if p > 64:
        raise ValueError("at most 64 columns; shrink_vectors() takes any number")
    rows = df.select(*columns).na.drop()
    n, *means = rows.agg(F.count("*"), *[F.avg(c) for c in columns]).first()
    dev = [F.col(c) - m for c, m in zip(columns, means)]
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.agg(*[F.avg(dev[i] * dev[j]) for i, j in upper], F.avg(F.pow(sum(d * d for d in dev), F.lit(2)))).first()
    s = np.zeros((p, p))
    for (i, j), v in zip(upper, got):
        s[i, j] = s[j, i] = v
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(((got[-1]) - (s**2).sum()) / p / n, d2)
    shrinkage = 0.0 if d2 == 0 else b2 / d2
    return (1 - shrinkage) * s + shrinkage * mu * np.eye(p), shrinkage
