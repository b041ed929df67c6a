"""Typed states of inputs, ledgers and campaigns: columns, never exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def probe_status(probes: DataFrame) -> DataFrame:
    """probes (http_status, observed_bytes, expected_bytes, columns, required, rows, expected_rows) with missing (required
    columns not there, sorted), size_matches, schema_matches and probe_status. Null expected_rows: any number."""
    missing = F.array_sort(F.array_except("required", "columns"))
    rows = F.col("expected_rows").isNull() | F.coalesce(F.col("rows") == F.col("expected_rows"), F.lit(False))
    out = probes.withColumn("missing", missing).withColumn("size_matches", F.coalesce(F.col("observed_bytes") == F.col("expected_bytes"), F.lit(False)))
    out = out.withColumn("schema_matches", (F.size("missing") == 0) & rows)
    # the names of the states are fixed values
    status = (
        F.when(~F.coalesce(F.col("http_status").isin(200, 206), F.lit(False)), "UNAVAILABLE_HTTP_STATUS")
        .when(F.col("size_matches") & F.col("schema_matches"), "AVAILABLE_SCHEMA_VERIFIED")
        .otherwise("AVAILABLE_SCHEMA_OR_SIZE_DRIFT")
    )
    return out.withColumn("probe_status", status)


def recoverability(probed: DataFrame) -> DataFrame:
    """One row: all_verified, n, expected_bytes, verdict."""
    good = F.coalesce(F.bool_and(F.col("probe_status") == "AVAILABLE_SCHEMA_VERIFIED"), F.lit(True))
    return probed.agg(good.alias("all_verified"), F.count("*").alias("n"), F.coalesce(F.sum("expected_bytes"), F.lit(0)).alias("expected_bytes"), F.when(good, "READY_ALL_INPUTS_VERIFIED").otherwise("NOT_READY_INPUT_FAILED_OR_DRIFTED").alias("verdict"))


def append_claims(ledger: DataFrame, claims: DataFrame, jurisdiction: str) -> DataFrame:
    """claims with ledger_decision: another jurisdiction is refused, then an id that the ledger has, then a second claim of one
    id (in the order of `seq`); the rest is appended. ledger: claim_id; claims: claim_id, seq, jurisdiction, ..."""
    known = ledger.select("claim_id").distinct().withColumn("__known", F.lit(True))
    ours = F.coalesce(F.col("jurisdiction") == jurisdiction, F.lit(False))
    place = F.row_number().over(Window.partitionBy("claim_id", ours).orderBy("seq"))
    out = claims.withColumn("__i", place).join(known, "claim_id", "left")
    decision = F.when(~ours, "REFUSED_JURISDICTION").when(F.col("__known") | (F.col("__i") > 1), "REFUSED_DUPLICATE_ID").otherwise("APPENDED")
    return out.withColumn("ledger_decision", decision).drop("__i", "__known")


def vector_status(channels: DataFrame, by: str, channel: str, status: str) -> DataFrame:
    """by and a map from channel to status: the vector stays a vector, no scalar comes of it. A channel that is told twice in
    different ways is AMBIGUOUS."""
    one = channels.where(F.col(channel).isNotNull()).groupBy(by, channel).agg(F.when(F.count_distinct(status) > 1, "AMBIGUOUS").otherwise(F.max(status)).alias("s"))
    return one.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(channel, "s")))).alias("channels"))


def cardinality_gate(df: DataFrame, by: str, least: int) -> DataFrame:
    """by, n, status: ESTIMABLE from `least` rows on, else NOT_ESTIMABLE."""
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("status", F.when(F.col("n") >= least, "ESTIMABLE").otherwise("NOT_ESTIMABLE"))


def interval(mean: Column, sigma: Column, z: float = 1.96) -> list[Column]:
    """low, high, includes_zero and z of a mean and its error."""
    low, high = mean - z * sigma, mean + z * sigma
    return [low.alias("low"), high.alias("high"), ((low <= 0) & (high >= 0)).alias("includes_zero"), F.when(sigma > 0, mean / sigma).alias("z")]


def decide(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The state of the first rule that holds."""
    out = F.when(*rules[0])
    for condition, state in rules[1:]:
        out = out.when(condition, state)
    return out.otherwise(otherwise)


def winner(df: DataFrame, by: str, stat: str, order: str) -> DataFrame:
    """by, the order column and stat of the row with the greatest stat; of equals the one first in order."""
    best = df.where(F.col(stat).isNotNull()).groupBy(by).agg(F.min(F.struct((-F.col(stat)).alias("s"), F.col(order).alias("o"))).alias("b"))
    return best.select(by, F.col("b.o").alias(order), (-F.col("b.s")).alias(stat))
