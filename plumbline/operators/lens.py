"""Profiles and their deprojection: log-log interpolation, spherical integrals, the operator as rows, stacks, tails."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import definite

#: Physical constants, fixed values: SI gravity, a solar mass in kg, kpc and Mpc in m, and gravity in Mpc (km/s)^2 / solar mass.
G_SI = 6.67430e-11
SOLAR_MASS_KG = 1.98847e30
KPC_M = 3.085677581491367e19
MPC_M = 3.085677581491367e22
G_MPC = 4.30091e-9


def log_profile(radius: np.ndarray, value: np.ndarray, query: np.ndarray, inner: float, outer: float) -> np.ndarray:
    """Straight lines between the logarithms; beyond either end a line of the given slope."""
    x, y, q = np.log(radius), np.log(value), np.log(query)
    inside = np.interp(q, x, y)
    below, above = y[0] + inner * (q - x[0]), y[-1] + outer * (q - x[-1])
    return np.exp(np.where(q < x[0], below, np.where(q > x[-1], above, inside)))


#: Knots that a profile may have in columns.
MOST_KNOTS = 1 << 12


def profile_knots(profiles: DataFrame, by: str, radius: str = "radius", value: str = "esd") -> DataFrame:
    """by and knots: each profile's logarithms of radius and value as one array (x, y) in order of radius; its bins are tens by
    contract, MOST_KNOTS at most. Bins that are null, infinite or not positive are left out, profiles with under two others too; of bins at
    one radius the greatest value counts."""
    fine = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf"))
    bins = profiles.where(fine(radius) & fine(value)).groupBy(by, radius).agg(F.max(value).alias("__v"))
    knots = F.array_sort(F.collect_list(F.struct(F.ln(radius).alias("x"), F.ln("__v").alias("y"))))
    return bins.groupBy(by).agg(knots.alias("knots")).where(F.size("knots").between(2, MOST_KNOTS))


def log_log(knots: Column, r: Column, inner: Column | float, outer: Column | float) -> Column:
    """The value at r of a profile of profile_knots(): straight lines between the logarithms, beyond either end a line of the given slope. The knot
    below is found by halves."""
    q, last = F.ln(r), F.size(knots) - 1
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_KNOTS.bit_length()))])
    # knots from the second on that are not above q: the interval's number
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(knots, at + step)["x"] <= q, at + step).otherwise(at))

    def line(at: Column) -> Column:
        low, high = F.get(knots, at), F.get(knots, at + 1)
        return low["y"] + (high["y"] - low["y"]) * (q - low["x"]) / (high["x"] - low["x"])

    # one place for each r: a second lambda holds it
    inside = F.get(F.transform(F.array(F.least(place, last - 1)), line), F.lit(0))
    first, end = F.get(knots, F.lit(0)), F.get(knots, last)
    slope = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.exp(F.when(q < first["x"], first["y"] + slope(inner) * (q - first["x"])).when(q > end["x"], end["y"] + slope(outer) * (q - end["x"])).otherwise(inside))


def deproject_lenses(profiles: DataFrame, masses: DataFrame, accelerations: list[float], inner: float, outer: float, points: int = 4096) -> DataFrame:
    """lens, gbar, gobs (m/s^2): for each lens 4 G times the integral of its profile at R / sin(angle) over a quarter turn, R
    being where its mass makes each acceleration. profiles: lens, radius (Mpc), esd (solar masses / Mpc^2); masses: lens,
    mass. Bins that are null or not positive are left out, lenses with under three others too. A lens is a group."""
    if points < 256:
        raise ValueError("at least 256 points")
    good = profiles.where("esd > 0 AND radius > 0 AND esd < double('Infinity')").join(masses.where("mass > 0"), "lens")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("radius")
        if len(pdf) < 3:
            return pd.DataFrame()
        g = np.asarray(accelerations, float)
        at = np.sqrt(G_SI * pdf.mass.iloc[0] * SOLAR_MASS_KG / g) / MPC_M
        angle = np.linspace(1e-8, math.pi / 2, points)
        values = log_profile(pdf.radius.to_numpy(float), pdf.esd.to_numpy(float), at[:, None] / np.sin(angle), inner, outer)
        return pd.DataFrame({"lens": pdf.lens.iloc[0], "gbar": g, "gobs": 4 * G_MPC * np.trapezoid(values, angle, axis=1) * 1e6 / MPC_M})

    return good.groupBy("lens").applyInPandas(run, f"lens {profiles.schema['lens'].dataType.simpleString()}, gbar double, gobs double")


def stack(lenses: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """gbar, gobs, lenses: the weighted mean over lenses (deprojected before) and how many count. weights: lens, weight;
    none: all 1."""
    each = lenses.withColumn("weight", F.lit(1.0)) if weights is None else lenses.join(weights, "lens")
    return each.where("weight > 0 AND gobs IS NOT NULL").groupBy("gbar").agg((F.sum(F.col("gobs") * F.col("weight")) / F.sum("weight")).alias("gobs"), F.count("*").alias("lenses"))


def _quadratic(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Values at q of the quadratic splines that are 1 at one of x and 0 at the others (knots half way, but for the first and
    last interval)."""
    middle = (x[1:] + x[:-1]) / 2
    knots = np.concatenate([[x[0]] * 3, middle[1:-1], [x[-1]] * 3])

    def basis(at: np.ndarray) -> np.ndarray:
        place = np.clip(np.searchsorted(knots, at, "right") - 1, 2, len(knots) - 4)
        level = (place[:, None] == np.arange(len(knots) - 1)).astype(float)
        for d in (1, 2):
            n = level.shape[1] - 1
            up, down = knots[d : d + n] - knots[:n], knots[d + 1 : d + 1 + n] - knots[1 : 1 + n]
            rise = np.divide(at[:, None] - knots[:n], up, out=np.zeros((len(at), n)), where=up > 0)
            fall = np.divide(knots[d + 1 : d + 1 + n] - at[:, None], down, out=np.zeros((len(at), n)), where=down > 0)
            level = rise * level[:, :-1] + fall * level[:, 1:]
        return level

    return np.linalg.solve(basis(x).T, basis(q).T).T


def deprojection_operator(spark: SparkSession, radius: list[float], nodes: int = 512, interpolation: str = "linear", tail: str = "sis") -> DataFrame:
    """i, j, v: deprojection_operators() for one list of radii."""
    if len(radius) < 3:
        raise ValueError("radii must be at least three, positive and growing")
    rows = spark.createDataFrame([(0, i, float(r)) for i, r in enumerate(radius)], "profile int, i int, radius double")
    return deprojection_operators(rows, "profile", nodes, interpolation, tail).select("i", "j", "v")


def deprojection_operators(radii: DataFrame, by: str, nodes: int = 512, interpolation: str = "linear", tail: str = "sis") -> DataFrame:
    """by, i, j, v: for each profile the matrix whose product with its values is their integral at R / sin(angle) over a quarter turn, by
    Gauss-Legendre nodes, for linear or quadratic interpolation; beyond the last radius the profile falls as 1 / R (sis), stays
    (flat) or is 0 (zero). radii: by, i (0 to n - 1), radius, which grows with i and is positive, or it is an error; a profile's radii are
    tens by contract, those of under three give no rows. Each row of a matrix is a row of Spark beside its profile's radii."""
    if nodes < 64 or interpolation not in ("linear", "quadratic") or tail not in ("sis", "flat", "zero"):
        raise ValueError("unsupported nodes, interpolation or tail")
    at, weight = np.polynomial.legendre.leggauss(nodes)
    sine, weight = np.sin((at + 1) * math.pi / 4), weight * math.pi / 4
    every = radii.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "radius"))).alias("__x")).select(by, F.col("__x.radius").alias("x")).where(F.size("x") >= 3)
    rows = radii.select(by, "i").join(every, by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, i, x in zip(f[by], f.i, f.x):
                x = np.asarray(x, float)
                if not (np.isfinite(x).all() and x[0] > 0 and (np.diff(x) > 0).all()):
                    raise ValueError("radii must be at least three, positive and growing")
                query = x[i] / sine
                inside = query <= x[-1]
                values = np.zeros((nodes, len(x)))
                if inside.any():
                    q = query[inside]
                    values[inside] = _quadratic(x, q) if interpolation == "quadratic" else np.stack([np.interp(q, x, unit) for unit in np.eye(len(x))], 1)
                values[~inside, -1] = {"sis": x[-1] / query[~inside], "flat": 1.0, "zero": 0.0}[tail]
                yield pd.DataFrame({by: key, "i": int(i), "j": np.arange(len(x)), "v": weight @ values})

    return rows.mapInPandas(run, f"`{by}` {radii.schema[by].dataType.simpleString()}, i int, j int, v double")


def operator_status(df: DataFrame, multiplier: float = 1.96) -> DataFrame:
    """df (exact, sis, zero, flat, quadratic, sigma) with difference, z, tail_low, tail_high, shift and status: what cannot be
    judged, then what tails or interpolation could explain, then what the error resolves or does not."""
    low, high = F.least("exact", "zero", "flat"), F.greatest("exact", "zero", "flat")
    out = df.withColumn("difference", F.col("exact") - F.col("sis")).withColumn("z", F.when(F.col("sigma") > 0, F.col("difference") / F.col("sigma")))
    out = out.withColumn("tail_low", low).withColumn("tail_high", high).withColumn("shift", F.abs(F.col("quadratic") - F.col("exact")))
    systematic = F.greatest((F.col("tail_high") - F.col("tail_low")) / 2, F.col("shift"))
    # the names of the states are fixed values
    status = (
        F.when(F.col("z").isNull() | F.isnan("z") | (F.col("sis") <= 0) | (F.col("exact") <= 0), "NOT_ESTIMABLE_NONPOSITIVE_OR_DEGENERATE")
        .when(systematic >= F.abs("difference"), "OPERATOR_DIFFERENCE_UNRESOLVED_SYSTEMATICS")
        .when(F.abs("z") >= multiplier, "OPERATOR_DIFFERENCE_RESOLVED_CONDITIONAL_95")
        .otherwise("OPERATOR_DIFFERENCE_STATISTICALLY_UNRESOLVED_95")
    )
    return out.withColumn("status", status)


#: Rows of a matrix whose eigenvalues one task finds.
ONE_TASK = 2048


def covariance_checks(c: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """One row on a covariance (i, j, v): size, cells, missing, asymmetric (pairs that differ by more), diagonal_bad (not above
    0), max_correlation off the diagonal, and positive_definite, least_eigenvalue and condition of the whole matrix (null where
    cells are missing, doubled or no numbers, or it is not symmetric). The transpose comes by an equi-join; eigenvalues by numpy
    in one task up to ONE_TASK rows, above that in blocks over all tasks when this is called (see definite.judge)."""
    rows = c.select("i").distinct().count()
    other = c.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("__t"))
    diagonal = c.where("i = j").select("i", F.col("v").alias("d"))
    both = c.join(other, ["i", "j"], "left").join(diagonal, "i", "left").join(diagonal.select(F.col("i").alias("j"), F.col("d").alias("e")), "j", "left")
    size = F.count_distinct("i")
    correlation = F.when((F.col("i") != F.col("j")) & (F.col("d") > 0) & (F.col("e") > 0), F.abs(F.col("v")) / F.sqrt(F.col("d") * F.col("e")))
    shape = both.agg(
        size.alias("size"),
        F.count("*").alias("cells"),
        (size * size - F.count("*")).alias("missing"),
        F.count_if(F.col("__t").isNull() | (F.abs(F.col("v") - F.col("__t")) > tolerance)).alias("asymmetric"),
        F.count_if((F.col("i") == F.col("j")) & ~(F.col("v") > 0)).alias("diagonal_bad"),
        F.max(correlation).alias("max_correlation"),
    )

    def eigen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"i": [], "j": [], "v": []}), *batches])
        names = np.unique(held.i)
        n = len(names)
        m = np.full((n, n), np.nan)
        m[np.searchsorted(names, held.i), np.searchsorted(names, held.j)] = held.v
        fine = n > 0 and len(held) == n * n and np.isfinite(m).all() and np.abs(m - m.T).max() <= tolerance
        low, high = np.linalg.eigvalsh(m)[[0, -1]] if fine else (None, None)
        yield pd.DataFrame({"positive_definite": [bool(low > 0) if fine else None], "least_eigenvalue": [low], "condition": [high / low if fine and low > 0 else None]})

    kinds = "positive_definite boolean, least_eigenvalue double, condition double"
    if rows > ONE_TASK:
        found = definite.judge(c, rows) if shape.first().asymmetric == 0 else (None, None, None)
        values = c.sparkSession.createDataFrame([found], kinds)
    else:
        values = c.select("i", "j", F.col("v").cast("double").alias("v")).repartition(1).mapInPandas(eigen, kinds)
    return shape.crossJoin(F.broadcast(values))  # one row


def block_diagonal(a: DataFrame, blocks: int, size: int) -> DataFrame:
    """The matrix (i, j, v) `blocks` times along the diagonal of a larger one; size: rows of one block."""
    moved = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * size)).alias("__o")
    return a.select("i", "j", "v", moved).select((F.col("i") + F.col("__o")).alias("i"), (F.col("j") + F.col("__o")).alias("j"), "v")


def corrected_covariance(c: DataFrame) -> DataFrame:
    """i, j, v: covariance (i, j, v) over the bias product (bias) of its cell; null where that is not above 0."""
    return c.select("i", "j", F.when(F.col("bias") > 0, F.col("v") / F.col("bias")).alias("v"))
