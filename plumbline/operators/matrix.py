"""Matrices as (i, j, v) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two (i, j, v) tables."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("__j"), F.col("v").alias("__v"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", F.col("__j").alias("j")).agg(F.sum(F.col("v") * F.col("__v")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def sandwich(a: DataFrame, c: DataFrame) -> DataFrame:
    """a c a'."""
    return multiply(multiply(a, c), transpose(a))
