"""Discrete Fourier transforms of series of any length over many tasks.

A series of n = n1 * n2 values is a table of n1 rows and n2 columns: columns are transformed, each result is turned by its
place, and rows are transformed; each of both is a group of some square root of n values, and what lies between is a shuffle. A
length without such factors is a convolution with a chirp, of a power of two. Series of up to SMALL values are one group each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import pieces
from plumbline.session import saved

#: Values up to which a series is one group, and the most values of one column or row of a larger one.
SMALL = 1 << 16
LIMIT = 1 << 17
_NAMES = ("n", "i", "re", "im")


def _kinds(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)


def _whole(df: DataFrame, by: list[str]) -> DataFrame:
    """Each series in one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.n.iloc[0])
        x = np.zeros(n, complex)
        x[pdf.i.to_numpy()] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        x = np.fft.fft(x)
        return pd.DataFrame({b: pdf[b].iloc[0] for b in by} | {"n": n, "i": np.arange(n), "re": x.real, "im": x.imag})

    return df.groupBy(*by).applyInPandas(run, _kinds(df, by) + "n long, i long, re double, im double")


def _four_steps(df: DataFrame, by: list[str], rows: Column) -> DataFrame:
    """Series as tables of `rows` rows, a divisor of n. i is row * columns + column; a result's is row + rows * column."""
    slim = df.select(*by, "n", rows.cast("long").alias("rows"), "i", "re", "im")
    columns = slim.withColumn("column", F.col("i") % (F.col("n") / F.col("rows")).cast("long"))

    def along_columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, height, column = (int(pdf[c].iloc[0]) for c in ("n", "rows", "column"))
        x = np.zeros(height, complex)
        x[pdf.i.to_numpy() // (n // height)] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        row = np.arange(height)
        x = np.fft.fft(x) * np.exp(-2j * np.pi * (row * column % n) / n)
        return pd.DataFrame({b: pdf[b].iloc[0] for b in by} | {"n": n, "rows": height, "row": row, "column": column, "re": x.real, "im": x.imag})

    turned = columns.groupBy(*by, "column").applyInPandas(along_columns, _kinds(df, by) + "n long, rows long, row long, column long, re double, im double")

    def along_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        n, height, row = (int(pdf[c].iloc[0]) for c in ("n", "rows", "row"))
        x = np.zeros(n // height, complex)
        x[pdf.column.to_numpy()] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        x = np.fft.fft(x)
        return pd.DataFrame({b: pdf[b].iloc[0] for b in by} | {"n": n, "i": row + height * np.arange(len(x)), "re": x.real, "im": x.imag})

    return turned.groupBy(*by, "row").applyInPandas(along_rows, _kinds(df, by) + "n long, i long, re double, im double")


def _chirp(df: DataFrame, by: list[str]) -> DataFrame:
    """Series of lengths without fitting divisors: products with exp(-pi i k^2 / n) before and after a convolution of a power of two."""
    size = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("n") - 1))).cast("long")
    height = F.pow(F.lit(2.0), F.floor(F.log2("n") / 2)).cast("long")  # of the longer table, near its square root
    angle = lambda k: F.lit(np.pi) * ((k * k) % (2 * F.col("length"))) / F.col("length")

    def times(rows: DataFrame, c: Column, s: Column) -> DataFrame:
        return rows.withColumn("__re", F.col("re") * c - F.col("im") * s).withColumn("im", F.col("re") * s + F.col("im") * c).withColumn("re", F.col("__re")).drop("__re")

    turned = times(df.withColumn("length", F.col("n")), F.cos(angle(F.col("i"))), -F.sin(angle(F.col("i"))))
    a = turned.select(*by, "length", size.alias("n"), "i", "re", "im")
    lengths = df.groupBy(*by).agg(F.first("n").alias("length"), F.first(size).alias("n"))
    k = F.explode(F.sequence(1 - F.col("length"), F.col("length") - 1))
    b = lengths.select(*by, "length", "n", k.alias("k")).select(*by, "length", "n", F.pmod(F.col("k"), F.col("n")).alias("i"), F.cos(angle(F.col("k"))).alias("re"), F.sin(angle(F.col("k"))).alias("im"))
    whole = lambda x: _four_steps(x, [*by, "length"], height)
    on = [*by, "length", "n", "i"]
    both = whole(a).join(whole(b).withColumnsRenamed({"re": "br", "im": "bi"}), on)
    product = both.select(*on, (F.col("re") * F.col("br") - F.col("im") * F.col("bi")).alias("re"), (-(F.col("re") * F.col("bi") + F.col("im") * F.col("br"))).alias("im"))
    back = whole(product).where("i < length").select(*by, "length", "i", (F.col("re") / F.col("n")).alias("re"), (-F.col("im") / F.col("n")).alias("im"))
    return times(back, F.cos(angle(F.col("i"))), -F.sin(angle(F.col("i")))).select(*by, F.col("length").alias("n"), "i", "re", "im")


def longest(df: DataFrame) -> int:
    """The greatest n of a table, counted when this is called."""
    return df.agg(F.max("n")).first()[0] or 0


def transform(df: DataFrame, by: list[str], inverse: bool = False, most: int | None = None) -> DataFrame:
    """by, n, i, re, im: the transform of each series (by, n, i, re, im) of n values, i being 0 to n - 1; a place without a row is 0. No key is
    null, and lengths stay below 2^31. most: the greatest n, where the caller knows it; else it is counted at once. Where there are
    longer series than SMALL, the input is written before it is dealt out, as several steps read it."""
    slim = df.select(*by, F.col("n").cast("long").alias("n"), F.col("i").cast("long").alias("i"), F.col("re").cast("double").alias("re"), (F.col("im") * (-1.0 if inverse else 1.0)).cast("double").alias("im"))
    n = F.col("n")
    if (longest(slim) if most is None else most) <= SMALL:
        out = _whole(slim, by)
    else:
        slim = saved(slim, "series")
        divisor = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt("n")).cast("long")), lambda d: F.col("n") % d == 0))
        lengths = saved(slim.select("n").distinct().where(n > SMALL).select("n", divisor.alias("__rows")), "lengths")  # a row for each length
        fits = F.col("__rows") * LIMIT >= n
        out = _whole(slim.where(n <= SMALL), by)
        if not lengths.where(fits).isEmpty():
            out = out.unionByName(_four_steps(slim.join(lengths.where(fits), "n"), by, F.col("__rows")))
        if not lengths.where(~fits).isEmpty():
            out = out.unionByName(_chirp(slim.join(lengths.where(~fits), "n").drop("__rows"), by))
    return out.withColumn("re", F.col("re") / n).withColumn("im", -F.col("im") / n) if inverse else out


def numbered_series(df: DataFrame, by: list[str], order: list[str], columns: list[str], least: int = 1) -> DataFrame:
    """by, n, i and columns as doubles: rows without a null or NaN, numbered from 0 in order in each series of `least` rows and more."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = pieces.numbered(df.where(good).select(*dict.fromkeys([*by, *order]), *[F.col(c).cast("double").alias(f"__{c}") for c in columns]), by, order)
    return rows.where(F.col("n") >= least).select(*by, "n", (F.col("i") - 1).alias("i"), *[F.col(f"__{c}").alias(c) for c in columns])
