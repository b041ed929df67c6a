"""Median, MAD and bias-corrected moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.pieces import join_alike
from plumbline.operators.selection import medians, quantiles
from plumbline.session import saved


def skew_score(skew: Column, n: Column) -> Column:
    """D'Agostino's normal score of a population skewness of n values (8 at least, else null)."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    y = F.when(y == 0, 1.0).otherwise(y) / F.sqrt(2 / (w2 - 1))
    return F.when(n >= 8, F.ln(y + F.sqrt(y * y + 1)) / F.sqrt(0.5 * F.ln(w2)))


def kurtosis_score(excess: Column, n: Column) -> Column:
    """Anscombe and Glynn's normal score of a population excess kurtosis of n values (5 at least, else null)."""
    mean = 3.0 * (n - 1) / (n + 1)
    spread = F.sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5)))
    skew = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    low = 1 + (excess + 3 - mean) / spread * F.sqrt(2 / (a - 4))
    root = F.signum(low) * F.cbrt((1 - 2 / a) / F.abs(F.nullif(low, F.lit(0.0))))
    return F.when(n >= 5, (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a)))


def residual_summary(df: DataFrame, by: str, v: str) -> DataFrame:
    """n, mean, sd, median, mad, bias-corrected skew and excess kurtosis, the share beyond 3 * 1.4826 * mad (0 when mad
    is 0), and D'Agostino's k2 with its p (null under 8 values or without spread). The medians come back by a join on the
    group. Groups and values are written once when this is called, as the medians read them several times; the sums add df's rows as they come,
    not in the order of written files, which varies."""
    fine = df.where(F.col(v).isNotNull() & ~F.isnan(v)).select(by, v)
    held = saved(fine, "residuals")
    centre = medians(held, [by], v)
    off = F.abs(F.col(v) - F.col("median"))
    mads = centre.join(medians(held.join(centre, by), [by], off, "mad"), by)
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    sums = fine.join(mads, by).groupBy(by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.first("median").alias("median"),
        F.first("mad").alias("mad"),
        F.skewness(v).alias("g1"),
        F.kurtosis(v).alias("g2"),
        F.avg(F.when((F.col("mad") > 0) & (off > 3 * 1.4826 * F.col("mad")), 1.0).otherwise(0.0)).alias("beyond"),
    )
    k2 = F.pow(skew_score(g1, n), F.lit(2)) + F.pow(kurtosis_score(g2, n), F.lit(2))
    out = sums.withColumn("skew", F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)))
    out = out.withColumn("kurtosis", F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))).withColumn("k2", F.when(~F.isnan(k2), k2))
    return out.withColumn("p", F.exp(-F.col("k2") / 2)).drop("g1", "g2")


def two_level_quantiles(df: DataFrame, group: str, member: str, v: str, least: int = 5) -> DataFrame:
    """group, n, q16, median, q84, status: each member's median, then quantiles over a group's members; null and INSUFFICIENT
    under `least` members, else DESCRIPTIVE."""
    out = quantiles(medians(df, [group, member], v, "m"), [group], "m", [0.16, 0.5, 0.84])
    enough = F.col("n") >= least
    value = lambda i: F.when(enough, F.col("q")[i])
    return out.select(group, "n", value(0).alias("q16"), value(1).alias("median"), value(2).alias("q84"), F.when(enough, "DESCRIPTIVE").otherwise("INSUFFICIENT").alias("status"))


def draw_quantiles(df: DataFrame, by: str, channel: str, channels: list[str], v: str, shares: list[float]) -> DataFrame:
    """by and a column <channel>_<percent> for each channel (a parameter) and share: quantiles over draws, nulls and NaN left out; null
    where a channel has none."""
    q = quantiles(df.where(F.col(channel).isin(channels)), [by, channel], v, shares)
    picked = [F.max(F.when(F.col(channel) == c, F.get("q", F.lit(i)))).alias(f"{c}_{int(s * 100)}") for c in channels for i, s in enumerate(shares)]
    return join_alike(df.select(by).distinct(), q.groupBy(by).agg(*picked), [by])


def ratio_summary(df: DataFrame, by: str, ratio: str, z: str) -> DataFrame:
    """by, n, median_ratio, max_abs_log10, z_median, z_max, z_over_2: of the finite positive ratios and of the absolute z."""
    good = F.col(ratio).isNotNull() & ~F.isnan(ratio) & (F.col(ratio) > 0) & (F.col(ratio) < float("inf"))
    value, size = F.when(good, F.col(ratio)), F.abs(z)
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.max(F.abs(F.log10(value))).alias("max_abs_log10"), F.max(size).alias("z_max"), F.count_if(size > 2).alias("z_over_2"))
    out = join_alike(join_alike(out, medians(df, [by], value, "median_ratio"), [by]), medians(df, [by], size, "z_median"), [by])
    return out.select(by, "n", "median_ratio", "max_abs_log10", "z_median", "z_max", "z_over_2")


def standardise(df: DataFrame, by: str, v: str) -> DataFrame:
    """df with z: v less its group's median, over 1.4826 * mad, or over the standard deviation where mad is 0."""
    centre = medians(df, [by], v, "__m").join(df.groupBy(by).agg(F.stddev_samp(v).alias("__sd")), by)
    mads = centre.join(medians(df.join(centre, by), [by], F.abs(F.col(v) - F.col("__m")), "__mad"), by)
    scale = F.when(F.col("__mad") > 0, 1.4826 * F.col("__mad")).otherwise(F.nullif(F.col("__sd"), F.lit(0.0)))
    return df.join(mads, by).withColumn("z", (F.col(v) - F.col("__m")) / scale).drop("__m", "__sd", "__mad")
