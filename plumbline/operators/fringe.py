"""Scores of signals beside nuisance terms: sums in Spark, small systems solved on rows of sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import waves
from plumbline.operators.selection import quantiles


def nuisance_terms(u: Column, phi: Column) -> list[Column]:
    """1, u, cos phi, sin phi, u cos phi, u sin phi."""
    return [F.lit(1.0), u, F.cos(phi), F.sin(phi), u * F.cos(phi), u * F.sin(phi)]


def fringe_slope(beta: list[float], u: Column, phi: Column) -> Column:
    """The derivative in phi of the fit over nuisance_terms."""
    return (beta[3] + beta[5] * u) * F.cos(phi) - (beta[2] + beta[4] * u) * F.sin(phi)


def fit_groups(df: DataFrame, by: str, y: str, terms: list[str]) -> DataFrame:
    """by, n, beta: least squares of y in terms for each group (no intercept of its own): sums of products, then one small
    system a row. Rows with a null are left out; groups of no more rows than terms give a null beta."""
    p = len(terms)
    rows = df.select(by, y, *terms).na.drop()
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in terms for b in terms]).alias("xx"), F.array(*[F.sum(F.col(a) * F.col(y)) for a in terms]).alias("xy"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            beta = [(np.linalg.pinv(np.reshape(a, (p, p)), hermitian=True) @ b).tolist() if n > p else None for n, a, b in zip(f.n, f.xx, f.xy)]
            yield pd.DataFrame({by: f[by], "n": f.n, "beta": beta})

    return sums.mapInPandas(run, f"`{by}` {df.schema[by].dataType.simpleString()}, n long, beta array<double>")


def quadrature_signals(df: DataFrame, by: list[str], t: str, frequency: str, sign: Column | None = None) -> DataFrame:
    """df with zc and zs: half the arm's sign (a column of +1 and -1; none: +2) times cos and sin of 2 pi f (t - t0), t0 being the
    first t of each group."""
    first = df.groupBy(*by).agg(F.min(t).alias("__t0"))
    size = sign * 0.5 if sign is not None else F.lit(1.0)
    angle = 2 * math.pi * F.col(frequency) * (F.col(t) - F.col("__t0"))
    return df.join(first, by).withColumn("zc", size * F.cos(angle)).withColumn("zs", size * F.sin(angle)).drop("__t0")


def profiled_scores(df: DataFrame, by: str, t: str, y: str, terms: list[str], frequencies: list[float], modulator: Column | None = None, scale: Column | None = None, apart: tuple[str, ...] = ()) -> DataFrame:
    """frequency, q_cos, q_sin, amplitude, phase, statistic for each frequency of a family (a parameter): the score test of
    modulator * (cos, sin)(2 pi f t) after each group's nuisance terms are projected out of the data and the signal.

    Sums of products for each group, and for each group and frequency (see waves.wave_sums), combine before the shuffle; a system of as many
    unknowns as terms is solved on each of these rows; groups then add up, but not over columns of `apart`, which stand
    beside the frequency in the result (a group has one value of them). Degenerate frequencies give no row."""
    p = len(terms)
    w = 1 / ((scale if scale is not None else F.lit(1.0)) * (scale if scale is not None else F.lit(1.0)))
    m = modulator if modulator is not None else F.lit(1.0)
    rows = df.select(by, *apart, F.col(t).alias("__t"), F.col(y).alias("__y"), m.alias("__m"), w.alias("__w"), *terms).na.drop()
    dot = lambda a, b: F.sum(F.col("__w") * F.col(a) * F.col(b))
    base = rows.groupBy(by, *apart).agg(F.array(*[dot(a, b) for a in terms for b in terms]).alias("xx"), F.array(*[dot(a, "__y") for a in terms]).alias("xy"))
    sums = waves.wave_sums(rows, [by, *apart], F.col("__t"), [*map(F.col, terms), F.col("__y")], frequencies, F.col("__w"), F.col("__m"))
    each = sums.select(by, *apart, "frequency", F.array(*[F.col(f"{z}{i}") for i in range(p) for z in "cs"]).alias("xz"), F.array("cc", "cs", "ss").alias("zz"), F.array(f"c{p}", f"s{p}").alias("zy"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            xx, xz = np.stack(f.xx).reshape(-1, p, p), np.stack(f.xz).reshape(-1, p, 2)
            back = np.swapaxes(xz, 1, 2) @ np.linalg.pinv(xx, hermitian=True)
            g = np.stack(f.zz)[:, [0, 1, 1, 2]].reshape(-1, 2, 2) - back @ xz
            s = np.stack(f.zy) - (back @ np.stack(f.xy)[:, :, None])[:, :, 0]
            yield pd.DataFrame({c: f[c] for c in apart} | {"frequency": f.frequency, "cc": g[:, 0, 0], "cs": g[:, 0, 1], "ss": g[:, 1, 1], "c": s[:, 0], "s": s[:, 1]})

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in apart)
    parts = each.join(base, [by, *apart]).mapInPandas(run, kinds + "frequency double, cc double, cs double, ss double, c double, s double")
    total = parts.groupBy(*apart, "frequency").agg(*[F.sum(x).alias(x) for x in ("cc", "cs", "ss", "c", "s")])
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    ok = total.where(det > 1e-12 * F.col("cc") * F.col("ss"))
    out = ok.select(*apart, "frequency", "c", "s", ((F.col("ss") * F.col("c") - F.col("cs") * F.col("s")) / det).alias("q_cos"), ((F.col("cc") * F.col("s") - F.col("cs") * F.col("c")) / det).alias("q_sin"))
    return out.select(*apart, "frequency", "q_cos", "q_sin", F.hypot("q_cos", "q_sin").alias("amplitude"), F.atan2("q_sin", "q_cos").alias("phase"), (F.col("c") * F.col("q_cos") + F.col("s") * F.col("q_sin")).alias("statistic"))


def gram(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """by, i, j, v: sums of products of all pairs of columns (few, by contract) for each group. Tasks multiply their
    batches as matrices and send one small matrix a group. Rows with a null are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for key, part in f.dropna().groupby(by):
                x = part[columns].to_numpy(float)
                held[key] = held.get(key, 0) + x.T @ x
        i, j = np.indices((len(columns), len(columns))).reshape(2, -1)
        for key, v in held.items():
            yield pd.DataFrame({by: key, "i": i, "j": j, "v": v.ravel()})

    kind = df.schema[by].dataType.simpleString()
    parts = df.select(by, *columns).mapInPandas(run, f"`{by}` {kind}, i int, j int, v double")
    return parts.groupBy(by, "i", "j").agg(F.sum("v").alias("v"))


def phase_proxy(df: DataFrame, by: str, arms: list[tuple[str, str, str]], share: float = 0.1) -> DataFrame:
    """df with phase and information: arms (coefficient, residual, scale columns) weighted by inverse variance; rows under the
    group's quantile `share` of information go."""
    info = sum(F.pow(F.col(c) / F.col(s), F.lit(2)) for c, _, s in arms)
    top = sum(F.col(c) * F.col(r) / F.pow(F.col(s), F.lit(2)) for c, r, s in arms)
    out = df.withColumn("information", info).withColumn("__top", top)
    cut = quantiles(out, [by], "information", [share]).select(by, F.get("q", F.lit(0)).alias("__cut"))
    return out.join(cut, by).where("information >= __cut AND __top IS NOT NULL").withColumn("phase", F.try_divide("__top", "information")).drop("__top", "__cut")
