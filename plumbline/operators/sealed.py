"""Sealed challenges: a plan from a secret seed, cases without labels, and the reveal, as stage tables.

The seed is a column of the one-row table that its holder keeps; what is published is its commitment, the cases and their
digests. Predictions are made from the cases alone, and the reveal joins them with the plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars


def _digest(seed, domain):
    return F.sha2(F.concat(F.unhex(seed), F.unhex(F.lit("00")), domain.cast("binary")), 256)


def plan(labels: DataFrame, seed_hex: str) -> DataFrame:
    """case_id, label, frequency, phase: the labels (label, frequency; one may be null-frequency, without a signal) in the order
    of a digest of the seed, under ids from their place. A challenge has a handful of cases."""
    seed = F.lit(seed_hex)
    order = Window.partitionBy(F.lit(1)).orderBy(_digest(seed, F.concat(F.lit("order:"), F.col("label"))))
    placed = labels.withColumn("__i", (F.row_number().over(order) - 1).cast("string"))
    turn = F.conv(F.substring(_digest(seed, F.concat(F.lit("phase:"), F.col("label"))), 1, 16), 16, 10).cast("double") / float(1 << 64)
    return placed.select(F.substring(_digest(seed, F.concat(F.lit("case:"), F.col("__i"))), 1, 16).alias("case_id"), "label", "frequency", F.when(F.col("frequency").isNotNull(), 2 * math.pi * turn).alias("phase"))


def seal(rows: DataFrame, plan_rows: DataFrame, t: str, y: str, amplitude: float, modulator=None) -> DataFrame:
    """case_id and the columns of rows, y with its case's wave added: modulator * amplitude * cos(2 pi f t - phase); neither label,
    frequency nor phase. Each row is repeated for each case of the plan, which holds a handful."""
    m = modulator if modulator is not None else F.lit(1.0)
    wave = amplitude * m * F.cos(2 * math.pi * F.col("__f") * F.col(t) - F.col("__p"))
    cases = F.broadcast(plan_rows.select("case_id", F.col("frequency").alias("__f"), F.col("phase").alias("__p")))
    return rows.crossJoin(cases).select("case_id", *[(F.col(c) + F.coalesce(wave, F.lit(0.0))).alias(c) if c == y else F.col(c) for c in rows.columns])


def seal_digest(cases: DataFrame, key: str, y: str) -> DataFrame:
    """case_id, n, digest: a digest of each case's values in no order, of exact sums of row digests, so that it adds up in tasks."""
    word = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col(y).cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return cases.groupBy("case_id").agg(F.count("*").alias("n"), F.sum(word).cast("string").alias("digest"))


def reveal(predictions: DataFrame, plan_rows: DataFrame, seed_hex: str, commitment: str) -> DataFrame:
    """case_id, label, predicted, outcome: predictions (case_id, predicted label or null) against the plan: SEED_MISMATCH where the
    seed is not the one committed to, then MISSING, CORRECT, WRONG, FALSE_ALARM (a signal seen in the case without one) or
    MISSED."""
    said = predictions.select("case_id", "predicted", F.lit(True).alias("__said"))
    null_case = F.col("frequency").isNull()
    outcome = (
        F.when(~F.coalesce(scalars.seed_commitment(F.lit(seed_hex)) == commitment, F.lit(False)), "SEED_MISMATCH")
        .when(F.col("__said").isNull(), "MISSING")
        .when(null_case, F.when(F.col("predicted").isNull(), "CORRECT").otherwise("FALSE_ALARM"))
        .when(F.col("predicted").isNull(), "MISSED")
        .when(F.col("predicted") == F.col("label"), "CORRECT")
        .otherwise("WRONG")
    )
    return plan_rows.join(said, "case_id", "left").select("case_id", "label", "predicted", outcome.alias("outcome"))
