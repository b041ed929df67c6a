"""Digests, manifests and typed claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(df: DataFrame, path: str, content: str) -> DataFrame:
    """path, byte_count and sha256 of each row's content."""
    raw = F.col(content).cast("binary")
    return df.select(F.col(path).alias("path"), F.octet_length(raw).cast("long").alias("byte_count"), F.sha2(raw, 256).alias("sha256"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and status of each expected entry: MISSING, BYTE_COUNT_MISMATCH, SHA256_MISMATCH or OK, in that order; and UNLISTED for
    each actual file that no entry expects."""
    a = actual.select("path", F.col("byte_count").alias("__n"), F.col("sha256").alias("__s"))
    status = F.when(F.col("__s").isNull(), "MISSING").when(F.col("byte_count") != F.col("__n"), "BYTE_COUNT_MISMATCH").when(F.col("sha256") != F.col("__s"), "SHA256_MISMATCH").otherwise("OK")
    both = expected.withColumn("__listed", F.lit(True)).join(a, "path", "full")
    return both.select("path", F.when(F.col("__listed").isNull(), "UNLISTED").otherwise(status).alias("status"))


def judge_claims(claims: DataFrame) -> DataFrame:
    """claims (claim_id, statement, kind, status, n_evidence, n_blocking) with a decision. Statements must not be blank;
    an observed, supported or contradicted claim needs evidence; only observations and associations are promoted; a
    not estimable one needs reasons."""
    decision = (
        F.when(F.length(F.trim("statement")) == 0, "REFUSED_EMPTY_FIELD")
        .when(F.col("status").isin("OBSERVED", "SUPPORTED", "CONTRADICTED") & (F.col("n_evidence") == 0), "REFUSED_NO_EVIDENCE")
        .when((F.col("status") == "NOT_ESTIMABLE") & (F.col("n_blocking") == 0), "REFUSED_NO_REASON")
        .when(~F.col("kind").isin("OBSERVATION", "ASSOCIATION") & (F.col("status") == "SUPPORTED"), "REFUSED_KIND")
        .when(F.col("status") == "NOT_ESTIMABLE", "RETAINED_UNRESOLVED")
        .otherwise("ACCEPTED")
    )
    return claims.withColumn("decision", decision)


def judge_envelopes(envelopes: DataFrame, required: list[str], start: str = "time_start", stop: str = "time_stop") -> DataFrame:
    """envelopes with envelope_status: EMPTY_FIELD where a required text is null or blank, TIME_ORDER where the start stands
    behind the stop (as texts, so ISO times of one form), else VALID."""
    blank = F.lit(False)
    for c in required:
        blank = blank | F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    status = F.when(blank, "EMPTY_FIELD").when(F.trim(start) > F.trim(stop), "TIME_ORDER").otherwise("VALID")
    return envelopes.withColumn("envelope_status", status)


def authority_payload(jurisdictions: DataFrame, envelopes: DataFrame, claims: DataFrame, decouplings: DataFrame, channels: DataFrame) -> DataFrame:
    """jurisdiction and payload: one struct for each jurisdiction with its valid envelopes, its accepted claims, its decouplings
    (each an array of structs in the order of its first column) and its vector of channels (name to status; absent: null).
    What a jurisdiction lacks is an empty array. All tables have a column jurisdiction; a claim has decision (see
    judge_claims). A jurisdiction is one report, a few hundred entries."""

    def gathered(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != "jurisdiction"]
        return df.groupBy("jurisdiction").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

    ok = claims.where(F.col("decision").isin("ACCEPTED", "RETAINED_UNRESOLVED"))
    valid = envelopes.where("envelope_status = 'VALID'").drop("envelope_status")
    parts = {"observation_envelopes": valid, "claims": ok, "decouplings": decouplings}
    out = jurisdictions.select("jurisdiction").distinct()
    for name, df in parts.items():
        made = gathered(df, name)
        none = F.array().cast(made.schema[name].dataType)
        out = out.join(made, "jurisdiction", "left").withColumn(name, F.coalesce(name, none))
    vector = channels.groupBy("jurisdiction").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "status")))).alias("vector"))
    out = out.join(vector, "jurisdiction", "left")
    return out.select("jurisdiction", F.struct(F.lit("1.0").alias("schema_version"), *parts, "vector").alias("payload"))


def capacity_gate(requests: DataFrame, jurisdiction: str, least_free_gib: int = 32) -> DataFrame:
    """requests (execution_jurisdiction, expected_bytes, free_bytes) with required_bytes and gate: REFUSED_JURISDICTION, then
    REFUSED_CAPACITY where less is free than the input or least_free_gib need, else ADMITTED."""
    need = F.greatest(F.col("expected_bytes"), F.lit(least_free_gib * 1024**3).cast("long"))
    gate = (
        F.when(~F.coalesce(F.col("execution_jurisdiction") == jurisdiction, F.lit(False)), "REFUSED_JURISDICTION")
        .when(~F.coalesce(F.col("free_bytes") >= need, F.lit(False)), "REFUSED_CAPACITY")
        .otherwise("ADMITTED")
    )
    return requests.withColumn("required_bytes", need).withColumn("gate", gate)


def stage_gate(stages: DataFrame) -> DataFrame:
    """stages (commit_id, sha256, expected_sha256, boundary_intact, config, expected_config) with gate: what a later stage may
    not start without, in this order: a commit id of 7 characters, the frozen file's digest, an untouched holdout, the
    frozen configuration; else OPEN."""
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    gate = (
        F.when(~F.coalesce(F.length("commit_id") >= 7, F.lit(False)), "ABSTAIN_COMMIT_ID")
        .when(~same("sha256", "expected_sha256"), "ABSTAIN_DIGEST_MISMATCH")
        .when(~F.coalesce(F.col("boundary_intact"), F.lit(False)), "ABSTAIN_BOUNDARY_CROSSED")
        .when(~same("config", "expected_config"), "ABSTAIN_CONFIG_CHANGED")
        .otherwise("OPEN")
    )
    return stages.withColumn("gate", gate)
