"""Regression, lag, coherence, frequency and rotation scans, as sums that combine before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import fourier, fringe, pieces, selection, waves


def project_nuisance(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """df with residual: y less its group's least-squares line in x."""
    fits = df.groupBy(by).agg(F.regr_slope(y, x).alias("__a"), F.regr_intercept(y, x).alias("__b"))
    return df.join(fits, by).withColumn("residual", F.col(y) - F.col("__a") * F.col(x) - F.col("__b")).drop("__a", "__b")


def project_standardised(df: DataFrame, by: str, xs: list[str], y: str) -> tuple[DataFrame, DataFrame]:
    """df with residual, and by, n, beta: y less its group's least squares in 1 and the columns xs, each less its mean over its sample
    deviation (1 where that is 0); beta is the intercept and then a coefficient of each standardised column. Rows with a
    null or NaN have no residual and no part in the fit; groups of no more rows than coefficients have neither."""
    rows = df
    good = F.lit(True)
    for c in [*xs, y]:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    scales = rows.where(good).groupBy(by).agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate(xs) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    names = [f"__z{i}" for i in range(len(xs))]
    both = rows.join(scales, by, "left")
    for i, c in enumerate(xs):
        both = both.withColumn(names[i], F.when(good, (F.col(c) - F.col(f"__m{i}")) / F.coalesce(F.nullif(F.col(f"__s{i}"), F.lit(0.0)), F.lit(1.0))))
    both = both.withColumn("__one", F.lit(1.0)).withColumn("__y", F.when(good, F.col(y).cast("double")))
    fits = fringe.fit_groups(both, by, "__y", ["__one", *names])
    out = both.join(fits.select(by, "beta"), by, "left")
    line = sum((F.col("beta")[i + 1] * F.col(n) for i, n in enumerate(names)), F.col("beta")[0])
    drop = [*names, "__one", "__y", "beta", *[f"__{n}{i}" for i in range(len(xs)) for n in "ms"]]
    return out.withColumn("residual", F.col("__y") - line).drop(*drop), fits


def lag_scan(x: DataFrame, y: DataFrame, most: int, least_pairs: int = 8) -> DataFrame:
    """lag, n, r for lags -most to most of two series (i, v) on one integer grid: x[i] against y[i + lag]. An equi-join
    on the shifted index, as many rows as pairs."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    left = x.select("i", F.col("v").alias("a"), lags.alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    pairs = left.join(y.select(F.col("i").alias("j"), F.col("v").alias("b")), "j")
    return pairs.groupBy("lag").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r")).where(F.col("n") >= least_pairs)


def frequency_scores(df: DataFrame, t: str, y: str, frequencies: list[float]) -> DataFrame:
    """frequency, a, b, power: the least-squares amplitude of cos and sin at each frequency of a family (a parameter, of any
    length), from five sums each that tasks add up as matrices."""
    g = waves.wave_sums(df, [], F.col(t), [F.col(y)], frequencies)
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    a = (F.col("ss") * F.col("c0") - F.col("cs") * F.col("s0")) / det
    b = (F.col("cc") * F.col("s0") - F.col("cs") * F.col("c0")) / det
    return g.where(det > 1e-9).select("frequency", a.alias("a"), b.alias("b"), (a * F.col("c0") + b * F.col("s0")).alias("power"))


def block_coherence(df: DataFrame, blocks: int, frequency: float) -> DataFrame:
    """One row: |sum conj(a) b|^2 / (sum |a|^2 sum |b|^2) over blocks of complex coefficients of columns x and y on
    the index i (0 to n - 1), and the number of blocks."""
    angle = 2 * math.pi * frequency * F.col("i")
    parts = df.withColumn("c", F.cos(angle)).withColumn("s", F.sin(angle)).groupBy("block").agg(*[F.sum(F.col(v) * F.col(w)).alias(v + w) for v in "xy" for w in "cs"])
    re = F.sum(F.col("xc") * F.col("yc") + F.col("xs") * F.col("ys"))
    im = F.sum(F.col("xc") * F.col("ys") - F.col("xs") * F.col("yc"))
    px, py = F.sum(F.col("xc") ** 2 + F.col("xs") ** 2), F.sum(F.col("yc") ** 2 + F.col("ys") ** 2)
    return parts.agg(((re * re + im * im) / (px * py)).alias("coherence"), F.count("*").alias("blocks"))


def _hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def segments(df: DataFrame, by: str, order: str, columns: list[str], most: int, width: float | None = None) -> DataFrame:
    """by, segment, size and one array of each column: the values of half-overlapping segments of each series less its
    least-squares line over the row number. Their size is the greatest power of two up to min(most, n). Rows with a null or NaN
    are left out before they are numbered; series under 16 rows give none. Ranges of the order column
    are numbered apart, and a segment is one group: no task has a whole series."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(good).select(by, order, *[F.col(c).cast("double").alias(c) for c in columns])
    rows = pieces.numbered(rows, [by], [order], width).where("n >= 16").withColumn("i", (F.col("i") - 1).cast("double"))
    lines = rows.groupBy(by).agg(*[f(c, "i").alias(f"__{n}_{c}") for c in columns for n, f in (("a", F.regr_slope), ("b", F.regr_intercept))])
    flat = rows.join(lines, by).select(by, "i", "n", *[(F.col(c) - F.col(f"__a_{c}") * F.col("i") - F.col(f"__b_{c}")).alias(c) for c in columns])
    size = F.pow(F.lit(2.0), F.floor(F.log2(F.least(F.col("n"), F.lit(most))))).cast("long")
    half = size / 2
    # a row is in the segment that begins at its half and in the one before
    place = F.floor(F.col("i") / half)
    both = flat.withColumn("size", size).withColumn("segment", F.explode(F.array(place - 1, place)))
    whole = both.where((F.col("segment") >= 0) & (F.col("segment") * half + size <= F.col("n")))
    return whole.groupBy(by, "segment", "size").agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("v")).select(by, "segment", "size", *[F.col(f"v.{c}").alias(c) for c in columns])


def welch(df: DataFrame, by: str, order: str, v: str, width: float | None = None, most: int = 256) -> DataFrame:
    """by, k, density: Welch's one-sided power density at frequency k / size: the series less its line, periodic Hann windows of
    the greatest power of two up to min(most, n), half overlapping, not detrended again. Each segment is transformed by
    itself, and their spectra add up; series under 16 values give no rows."""
    kind = df.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for size, part in f.groupby("size"):
                w = _hann(size)
                p = np.abs(np.fft.rfft(np.stack(part[v]) * w)) ** 2 / (w @ w)
                p[:, 1:-1] *= 2
                yield pd.DataFrame({by: np.repeat(part[by].to_numpy(), p.shape[1]), "k": np.tile(np.arange(p.shape[1]), len(part)), "p": p.ravel()})

    each = segments(df, by, order, [v], most, width).select(by, "size", v).mapInPandas(run, f"`{by}` {kind}, k int, p double")
    return each.groupBy(by, "k").agg(F.avg("p").alias("density"))


def coherence(df: DataFrame, by: str, order: str, x: str, y: str, width: float | None = None, most: int = 128) -> DataFrame:
    """by, k, coherence: magnitude-squared coherence of linearly detrended series, segments without their means. Rows with a null in
    either are left out first. Segments are transformed by themselves, and four sums of each frequency add up; null where a
    power is 0."""
    kind = df.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for size, part in f.groupby("size"):
                a, b = (np.fft.rfft((s - s.mean(1, keepdims=True)) * _hann(size)) for s in (np.stack(part[x]), np.stack(part[y])))
                cross, n = np.conj(a) * b, size // 2 + 1
                sums = {"re": cross.real, "im": cross.imag, "pa": np.abs(a) ** 2, "pb": np.abs(b) ** 2}
                yield pd.DataFrame({by: np.repeat(part[by].to_numpy(), n), "k": np.tile(np.arange(n), len(part))} | {c: s.ravel() for c, s in sums.items()})

    each = segments(df, by, order, [x, y], most, width).select(by, "size", x, y).mapInPandas(run, f"`{by}` {kind}, k int, re double, im double, pa double, pb double")
    sums = each.groupBy(by, "k").agg(*[F.sum(c).alias(c) for c in ("re", "im", "pa", "pb")])
    power = F.col("pa") * F.col("pb")
    return sums.select(by, "k", F.when(power > 0, (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / power).alias("coherence"))


def greatest_coherence(spectra: DataFrame, by: str) -> DataFrame:
    """by, k, coherence, bins: the greatest coherence over positive frequencies (of those equal to nine digits the lowest), and how
    many frequencies there are."""
    rows = spectra.where("k > 0")
    best = rows.groupBy(by).agg(F.min(F.struct((-F.round("coherence", 9)).alias("c"), "k")).alias("b"), F.count("*").alias("bins"))
    return best.select(by, F.col("b.k").alias("k"), (-F.col("b.c")).alias("coherence"), "bins")


def periodogram(df: DataFrame, by: str, order: str, v: str, dt: float = 1.0) -> DataFrame:
    """by, frequency, density: the one-sided periodogram of each series less its line over the row number; series under 16 values
    give no rows. Rows are numbered in ranges of the order column, a number that tells a series' rows apart, and long series are transformed over many
    tasks (see fourier.transform)."""
    rows = fourier.numbered_series(df.select(F.col(by).alias("__by"), F.col(order).alias("__order"), F.col(v).alias("__v")).where("__by IS NOT NULL"), ["__by"], ["__order"], ["__v"], 16)
    lines = rows.groupBy("__by").agg(F.regr_slope("__v", "i").alias("__a"), F.regr_intercept("__v", "i").alias("__b"))
    flat = rows.join(lines, "__by").select("__by", "n", "i", (F.col("__v") - F.col("__a") * F.col("i") - F.col("__b")).alias("re"), F.lit(0.0).alias("im"))
    half = fourier.transform(flat, ["__by"]).where(2 * F.col("i") <= F.col("n"))
    twice = F.when((F.col("i") > 0) & (2 * F.col("i") < F.col("n")), 2.0).otherwise(1.0)
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n") * twice * dt
    return half.select(F.col("__by").alias(by), (F.col("i") / (F.col("n") * dt)).alias("frequency"), power.alias("density"))


def whittle(df: DataFrame, by: str, observed: str = "observed", model: str = "model") -> DataFrame:
    """by, loglik, bins: - sum(log S + I / S) over bins with a positive model; groups without any give no row."""
    ok = df.where((F.col(model) > 0) & F.col(observed).isNotNull() & ~F.isnan(observed) & (F.col(model) < float("inf")) & (F.col(observed) < float("inf")))
    return ok.groupBy(by).agg((-F.sum(F.log(model) + F.col(observed) / F.col(model))).alias("loglik"), F.count("*").alias("bins"))


def whittle_baseline(df: DataFrame, by: str, order: str, v: str, width: float | None = None, dt: float = 1.0, most: int = 256) -> DataFrame:
    """by, loglik, bins of each series' periodogram under its own Welch density, drawn out on straight lines to the periodogram's
    positive frequencies and kept above 1e-12 of its median. Spectra meet by their frequencies; the likelihood is whittle()'s."""
    observed = periodogram(df, by, order, v, dt).where("frequency > 0").withColumnRenamed("density", "observed")
    model = welch(df, by, order, v, width, most)
    top = model.groupBy(by).agg((F.max("k") * 2).alias("__size"))
    here = observed.join(top, by).withColumn("__at", F.col("frequency") * dt * F.col("__size"))
    # two bins of the coarser spectrum stand beside each of the finer one
    low = F.least(F.floor(F.col("__at") + 1e-9), (F.col("__size") / 2 - 1).cast("long"))
    both = here.withColumn("__low", low).select(by, "frequency", "observed", F.explode(F.array(F.struct(F.col("__low").cast("int").alias("k"), (1 - (F.col("__at") - F.col("__low"))).alias("w")), F.struct((F.col("__low") + 1).cast("int").alias("k"), (F.col("__at") - F.col("__low")).alias("w")))).alias("b"))
    both = both.select(by, "frequency", "observed", "b.k", "b.w").join(model, [by, "k"])
    drawn = both.groupBy(by, "frequency").agg(F.first("observed").alias("observed"), (F.sum(F.col("w") * F.col("density")) * dt).alias("model"))
    floor = selection.medians(drawn, [by], "model", "__m").select(by, (F.col("__m") * 1e-12).alias("__floor"))
    least = F.when(F.col("__floor") > 0, F.col("__floor")).otherwise(2.2250738585072014e-308)
    return whittle(drawn.join(floor, by).withColumn("model", F.greatest("model", least)), by)


def equal_blocks(df: DataFrame, t: str, blocks: int) -> DataFrame:
    """df with block (0 to blocks - 1): equal lengths of time from the first to just after the last row, each without its end."""
    ends = df.agg(F.min(t).alias("__lo"), (F.max(t) + 1e-6).alias("__hi"))
    place = F.least(F.floor((F.col(t) - F.col("__lo")) * blocks / (F.col("__hi") - F.col("__lo"))), F.lit(blocks - 1).cast("long")).cast("int")
    return df.crossJoin(F.broadcast(ends)).withColumn("block", place).drop("__lo", "__hi")  # one row


def block_coefficients(df: DataFrame, by: list[str], t: str, v: str, frequency: float, origin: float = 0.0, weight: str | None = None, least: int = 8) -> DataFrame:
    """by, n, re, im: sum(w * residual * exp(-2 pi i f (t - origin))) / sqrt(sum w) for each block, the residual being v less its
    weighted line in t; null under `least` rows. Two sums: the line, then the wave."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*by, F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v"), w.cast("double").alias("w")).where("w > 0 AND NOT isnan(v)").na.drop(subset=["t", "v", "w"])
    middle = rows.groupBy(*by).agg((F.sum(F.col("w") * F.col("t")) / F.sum("w")).alias("mt"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mv"))
    near = rows.join(middle, by).withColumn("x", F.col("t") - F.col("mt")).withColumn("y", F.col("v") - F.col("mv"))
    angle = 2 * math.pi * frequency * (F.col("t") - origin)
    # the residual is linear in the slope: the sums that it needs come in the same pass
    terms = {"sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y"), "yc": F.col("y") * F.cos(angle), "ys": F.col("y") * F.sin(angle), "xc": F.col("x") * F.cos(angle), "xs": F.col("x") * F.sin(angle)}
    sums = near.groupBy(*by).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), *[F.sum(F.col("w") * c).alias(k) for k, c in terms.items()])
    slope = F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0))
    value = lambda y, x: F.when(F.col("n") >= least, (F.col(y) - slope * F.col(x)) / F.sqrt("sw"))
    return sums.select(*by, "n", value("yc", "xc").alias("re"), (-value("ys", "xs")).alias("im"))


def allan_deviation(df: DataFrame, by: str, i: str, v: str, factors: list[int], rows: int = 1 << 20) -> DataFrame:
    """by, m, n, deviation: the overlapping Allan deviation of readings on a gapless grid i (unit spacing) at averages of m
    readings. Running sums once, then two lags for each m. The grid is cut into ranges of `rows`, each with the next rows that
    the longest average needs, so that a task has one range."""
    reach = 2 * max(factors)
    if rows <= reach:
        raise ValueError("a range must hold the longest average twice")
    piece = F.floor(F.col(i) / rows)
    own = df.select(by, i, v, F.explode(F.array_distinct(F.array(piece, F.floor((F.col(i) - reach + 1) / rows)))).alias("__p"))
    w = Window.partitionBy(by, "__p").orderBy(i)
    total = own.withColumn("s", F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("p", F.col("s") - F.col(v))
    # p: the sum of the range's readings before i; a window of m readings from i is p[i + m] - p[i]
    ends = total.groupBy(by, "__p").agg(F.max(F.struct(i, "s")).alias("e")).select(by, "__p", (F.col(f"e.{i}") + 1).alias(i), F.col("e.s").alias("p"))
    phase = total.select(by, "__p", i, "p").unionByName(ends)
    step = lambda m: F.lead("p", 2 * m).over(w) - 2 * F.lead("p", m).over(w) + F.col("p")
    moved = phase.select(by, "__p", i, *[step(m).alias(f"d{m}") for m in factors]).where(F.floor(F.col(i) / rows) == F.col("__p"))
    each = moved.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"d{m}").alias("d")) for m in factors])).alias("r")).select(by, "r.*").where("d IS NOT NULL")
    return each.groupBy(by, "m").agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("d") * F.col("d")) / (2 * F.col("m") * F.col("m") * F.count("*"))).alias("deviation"))
