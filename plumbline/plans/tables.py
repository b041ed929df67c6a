"""Queries over the star tables and documents: selection, gates, ratios, custody, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import custody, fringe, joins, lens, matrix, ordered, robust, series, shadow


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nuisance_projection(spark, sf_dir):
    """Extended price less its line in quantity, by return flag: the residuals' spread."""
    out = series.project_nuisance(_t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_returnflag", "l_quantity", "l_extendedprice")
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.stddev_samp("residual"), 3).alias("sd"))


def exact_mode_majority(spark, sf_dir):
    return ordered.exact_mode(_t(spark, sf_dir, "part"), "p_brand", "p_size")


def quality_attrition(spark, sf_dir):
    """Orders kept and refused by reason; the duplicate flag is set before any filter."""
    rules = [("PRICE", F.col("o_totalprice") >= 1000), ("STATUS", F.col("o_orderstatus").isin("O", "F"))]
    judged = ordered.quality_chain(_t(spark, sf_dir, "orders"), rules, ["o_custkey", "o_orderdate"], ["o_orderkey"])
    return ordered.attrition(judged, 500)


def structural_filter(spark, sf_dir):
    """Lines with finite prices, a discount and a tax from 0 to 1, and two of the line statuses, by status."""
    li = _t(spark, sf_dir, "lineitem").withColumn("condition", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2))
    kept = ordered.structural(li.withColumn("share", F.col("l_quantity") / 40), ["l_extendedprice"], ["share", "l_discount"], "condition", [0, 2])
    return kept.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def final_iterations(spark, sf_dir):
    """Each customer's orders of the last day on which they ordered."""
    out = ordered.final_iteration(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate")
    return out.select("o_custkey", "o_orderkey")


def dedupe_first_last(spark, sf_dir):
    """Each customer's first and last order."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = ordered.keep_one(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_key"))
    last = ordered.keep_one(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True).select("o_custkey", F.col("o_orderkey").alias("last_key"))
    return first.join(last, "o_custkey")


def wilson_lower(spark, sf_dir):
    """The lower bound of the share of finished orders by priority."""
    out = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    return out.select("o_orderpriority", "n", F.round(scalars.wilson_lower(F.col("k"), F.col("n"), 1.96), 9).alias("lower"))


def band_join_two_level_median(spark, sf_dir):
    """Around ten price centres: the median unit price of each supplier's lines in the band, then quantiles over suppliers."""
    lines = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    centres = spark.range(1, 11).select(F.col("id").alias("band"), (F.col("id") * 180.0 + 100).alias("centre"))
    pairs = joins.band_join(centres, lines, "centre", "unit", 25.0)
    out = robust.two_level_quantiles(pairs, "band", "l_suppkey", "unit")
    return out.select("band", "n", *[F.round(c, 6).alias(c) for c in ("q16", "median", "q84")], "status")


def ratio_summary(spark, sf_dir):
    """Prices over a thousand as ratios and z by order status."""
    o = _t(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_totalprice").cast("double") / 1000 - F.col("o_orderkey") % 2 * 1e6).alias("ratio"), (F.col("o_custkey") % 9 - 4.0).alias("z"))
    out = robust.ratio_summary(o, "o_orderstatus", "ratio", "z")
    return out.select("o_orderstatus", "n", *[F.round(c, 9).alias(c) for c in ("median_ratio", "max_abs_log10", "z_median", "z_max")], "z_over_2")


def signed_shadow_status(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    excess = F.log10(F.col("o_totalprice") / 100000.0)
    sigma = scalars.quadrature(F.lit(0.05), F.col("o_custkey") % 10 / 20.0)
    return o.select("o_orderkey", F.round(excess, 6).alias("excess"), F.round(sigma, 6).alias("sigma"), scalars.log10_excess_status(excess, sigma).alias("status"))


def lensing_shadow(spark, sf_dir):
    """Customers as pairs of accelerations with errors: the signed difference, its envelope, its state, the tail."""
    k = F.col("c_custkey")
    c = _t(spark, sf_dir, "customer").select("c_custkey", (-15.6 + k % 40 * 0.1).alias("bar"), (-15.0 + k % 37 * 0.1).alias("obs"), (0.02 + k % 11 * 0.03).alias("stat"))
    out = c.select("c_custkey", *scalars.lensing_shadow(F.col("bar"), F.col("obs"), scalars.quadrature(F.col("stat"), F.lit(0.05), F.lit(0.1))))
    return out.select("c_custkey", (F.round("eta", 9) + 0.0).alias("eta"), *[(F.round(F.col(x) * 1e12, 6) + 0.0).alias(x) for x in ("difference", "low", "high")], "status", "reach")


def validated_join(spark, sf_dir):
    """Orders with their customer, many to one, then cuts."""
    both = joins.many_to_one(_t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_mktsegment"), "k")
    kept = both.where((F.col("join_status") != "MATCHED") | ((F.col("c_acctbal") > 0) & (F.col("o_totalprice") > 5000)))
    return kept.groupBy("join_status", "c_mktsegment").agg(F.count("*").alias("n"))


def ambiguous_join(spark, sf_dir):
    """Nations with the customers of one segment: none, one, or more than one, of which none is picked."""
    few = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 9400").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return joins.many_to_one(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), few, "n_nationkey")


def unmatched_keys(spark, sf_dir):
    """The first five customers without an order of one status."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return joins.unmatched_keys(c, _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k")


def suffix_lookup(spark, sf_dir):
    """Suffixes of file names from nations against entries from customers: one, none or several."""
    entries = _t(spark, sf_dir, "customer").select(F.concat(F.lit("raw/"), F.col("c_mktsegment"), F.lit("/run"), (F.col("c_custkey") % 400).cast("string"), F.lit(".csv")).alias("path"))
    names = _t(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("BUILDING/run"), F.col("n_nationkey").cast("string"), F.lit(".csv"))).otherwise(F.concat(F.lit("un"), (F.col("n_nationkey") * 30).cast("string"), F.lit(".csv"))).alias("suffix"))
    return joins.suffix_lookup(names, entries).select("suffix", "path", "n", "lookup_status")


def weighted_ratio_accumulation(spark, sf_dir):
    """Lines as pairs of a lens (supplier) and a source, accumulated by lens and quantity bin; empty cells are null."""
    pairs = _t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("lens_index"),
        F.col("l_quantity").cast("double").alias("projected_radius_mpc"),
        (F.col("l_orderkey") % 4 * 1.0).alias("source_weight"),
        (F.col("l_quantity") + 1.0).cast("double").alias("sigma_critical"),
        (F.col("l_discount") - 0.04).cast("double").alias("tangential"),
        (F.col("l_tax") - 0.03).cast("double").alias("cross"),
        (F.col("l_tax") - F.when(F.col("l_linenumber") == 7, 2).otherwise(0)).cast("double").alias("multiplicative_bias"),
    )
    out = shadow.accumulate_esd(pairs, [2.0, 10.0, 20.0, 35.0, 49.0], lenses=80)
    return out.select("lens_index", "bin", F.round("esd", 6).alias("esd"), F.round("cross_esd", 6).alias("cross_esd"), "pairs")


def histogram_cells(spark, sf_dir):
    """How many lines with a weight each bin of quantity has, over all suppliers."""
    pairs = _t(spark, sf_dir, "lineitem").select(F.lit(0).alias("lens_index"), F.col("l_quantity").cast("double").alias("projected_radius_mpc"), F.lit(1.0).alias("source_weight"), F.lit(1.0).alias("sigma_critical"), F.lit(0.0).alias("tangential"), F.lit(0.0).alias("cross"), F.lit(0.0).alias("multiplicative_bias"))
    return shadow.accumulate_esd(pairs, [1.0, 5.0, 5.5, 30.0, 50.0, 60.0]).select("bin", "pairs")


def _second_moments(spark, sf_dir):
    """i, j, v: sums of products of all pairs of the embeddings' components; tasks send one small matrix each."""
    v = _t(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    size = v.agg(F.max(F.size("embedding"))).first()[0] or 1
    wide = v.select(F.lit(0).alias("g"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(size)])
    return fringe.gram(wide, [f"x{k}" for k in range(size)], "g").select("i", "j", "v")


def covariance_sandwich(spark, sf_dir):
    """A C A' of the second moments of the embeddings' components, with a bidiagonal A."""
    c = _second_moments(spark, sf_dir)
    size = F.broadcast(c.agg((F.max("i") + 1).alias("size")))  # one row
    rows = c.select("i").distinct()
    near = rows.select("i", F.explode(F.array(F.struct(F.col("i").alias("j"), F.lit(1.0).alias("v")), F.struct((F.col("i") + 1).alias("j"), F.lit(-0.5).alias("v")))).alias("c")).select("i", "c.j", "c.v")
    near = near.crossJoin(size).where("j < size").drop("size")
    return matrix.sandwich(near, c).select("i", "j", F.round("v", 5).alias("v"))


def manifest_digest(spark, sf_dir):
    return custody.manifest(_t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text")), "path", "text")


def manifest_verify(spark, sf_dir):
    """Documents but every eleventh against labelled documents with one byte changed in every seventh."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    expected = custody.manifest(docs.where("doc_id % 11 <> 0"), "path", "text")
    there = docs.join(_t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    changed = there.select("path", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), F.substring("text", 2, 1 << 30))).otherwise(F.col("text")).alias("text"))
    return custody.verify(expected, custody.manifest(changed, "path", "text"))


def block_diagonal(spark, sf_dir):
    """A matrix of parts' sizes by two digits of their keys, three times along a diagonal; and what a bias takes from it."""
    p = _t(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 5).cast("int").alias("i"), (F.floor(F.col("p_partkey") / 5) % 5).cast("int").alias("j")).agg(F.avg(F.col("p_size").cast("double")).alias("v"))
    fair = lens.corrected_covariance(p.withColumn("bias", (F.col("i") + F.col("j")) / 4.0))
    return lens.block_diagonal(fair, 3, 5).select("i", "j", F.round("v", 6).alias("v"))


def covariance_checks(spark, sf_dir):
    """The second moments of all components of the embeddings, checked."""
    out = lens.covariance_checks(_second_moments(spark, sf_dir), 1e-6)
    bounded = (F.col("condition") >= 1) & (F.col("least_eigenvalue") > 0)
    return out.select("size", "cells", "missing", "asymmetric", "diagonal_bad", F.round("max_correlation", 6).alias("max_correlation"), "positive_definite", bounded.alias("conditioned"))


def envelope_checks(spark, sf_dir):
    """Orders as envelopes: an empty clerk, dates out of order."""
    e = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time_start"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 9 - 2).cast("int")), "yyyy-MM-dd").alias("time_stop"))
    return custody.judge_envelopes(e, ["source", "time_start", "time_stop"]).groupBy("envelope_status").agg(F.count("*").alias("n"))


def capacity_gate(spark, sf_dir):
    """Suppliers as requests for disk."""
    k = F.col("s_suppkey")
    r = _t(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 7 == 0, "laptop").otherwise("remote").alias("execution_jurisdiction"), (k.cast("long") * 2**30).alias("expected_bytes"), F.when(k % 11 > 0, (k % 50 + 8).cast("long") * 2**30).alias("free_bytes"))
    return custody.capacity_gate(r, "remote", 20)


def stage_gate(spark, sf_dir):
    """Customers as stages of a campaign, by gate."""
    k = F.col("c_custkey")
    s = _t(spark, sf_dir, "customer").select(F.substring(F.sha2(k.cast("string"), 256), 1, (k % 10 + 4).cast("int")).alias("commit_id"), F.sha2((k % 4).cast("string"), 256).alias("sha256"), F.sha2((k % 8).cast("string"), 256).alias("expected_sha256"), (k % 5 > 0).alias("boundary_intact"), (k % 3).alias("config"), F.lit(1).alias("expected_config"))
    return custody.stage_gate(s).groupBy("gate").agg(F.count("*").alias("n"))


def authority_payload(spark, sf_dir):
    """Regions as jurisdictions: their nations as envelopes and channels, the claims of their suppliers; the payload as JSON text."""
    n = _t(spark, sf_dir, "nation").withColumn("jurisdiction", F.col("n_regionkey"))
    where = n.select(F.col("n_nationkey").alias("s_nationkey"), "jurisdiction")
    envelopes = n.select("jurisdiction", F.col("n_nationkey").alias("envelope_id"), F.when(F.col("n_nationkey") % 7 == 0, "").otherwise(F.col("n_name")).alias("source"), F.lit("1").alias("time_start"), F.lit("2").alias("time_stop"))
    s = _t(spark, sf_dir, "supplier").join(where, "s_nationkey").where("s_suppkey % 4 = 0")
    kind = F.when(F.col("s_suppkey") % 8 == 0, "OBSERVATION").otherwise("CAUSAL")
    claims = s.select("jurisdiction", F.col("s_suppkey").alias("claim_id"), F.col("s_name").alias("statement"), kind.alias("kind"), F.when(F.col("s_suppkey") % 12 == 0, "NOT_ESTIMABLE").otherwise("SUPPORTED").alias("status"), F.lit(1).alias("n_evidence"), (F.col("s_suppkey") % 3).alias("n_blocking"))
    decouplings = n.where("n_nationkey % 6 = 1").select("jurisdiction", F.col("n_nationkey").alias("decoupling_id"), F.lit("difference").alias("statistic"))
    channels = n.select("jurisdiction", F.col("n_name").alias("channel"), F.when(F.col("n_nationkey") % 2 == 0, "SUPPORTED").otherwise("NOT_ESTIMABLE").alias("status"))
    made = custody.authority_payload(n.select("jurisdiction"), custody.judge_envelopes(envelopes, ["source"]), custody.judge_claims(claims), decouplings, channels)
    p = lambda c: F.col(f"payload.{c}")
    ids = lambda c, k: F.array_join(F.transform(p(c), lambda x: x[k].cast("string")), ",")
    vector = F.array_join(F.transform(F.map_entries(p("vector")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return made.select("jurisdiction", p("schema_version").alias("schema_version"), ids("observation_envelopes", "envelope_id").alias("envelopes"), ids("claims", "claim_id").alias("claims"), ids("decouplings", "decoupling_id").alias("decouplings"), vector.alias("vector"))


def seed_plan_order(spark, sf_dir):
    """Nations by a seeded digest, and a phase from it."""
    n = _t(spark, sf_dir, "nation")
    return n.select("n_name", F.sha2(F.concat(F.lit("plan-7"), F.lit("\x00"), F.col("n_name")).cast("binary"), 256).alias("digest"), F.round(scalars.seed_phase("plan-7", F.col("n_name")), 9).alias("phase"))


def claim_promotion_rules(spark, sf_dir):
    """Conversation turns as claims, judged."""
    c = _t(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "OBSERVATION").when(F.col("role") == "assistant", "ASSOCIATION").otherwise("INTERPRETATION")
    status = F.when(F.col("turn") % 4 == 0, "SUPPORTED").when(F.col("turn") % 4 == 1, "OBSERVED").when(F.col("turn") % 4 == 2, "NOT_ESTIMABLE").otherwise("PROPOSED")
    claims = c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("statement"), kind.alias("kind"), status.alias("status"), (F.col("conv_id") % 3).alias("n_evidence"), (F.col("turn") % 3).alias("n_blocking"))
    return custody.judge_claims(claims).groupBy("kind", "status", "decision").agg(F.count("*").alias("n"))


def vector_channel_expand(spark, sf_dir):
    """Components of the embeddings by place: count, sum, extremes."""
    v = _t(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    return v.groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 5).alias("total"), F.round(F.max(F.col("x").cast("double")), 6).alias("greatest"))


PLANS = [nuisance_projection, exact_mode_majority, quality_attrition, dedupe_first_last, wilson_lower, band_join_two_level_median, signed_shadow_status, validated_join, weighted_ratio_accumulation, covariance_sandwich, structural_filter, final_iterations, ratio_summary, lensing_shadow, ambiguous_join, unmatched_keys, suffix_lookup, histogram_cells, block_diagonal, covariance_checks, envelope_checks, capacity_gate, stage_gate, authority_payload, manifest_digest, manifest_verify, seed_plan_order, claim_promotion_rules, vector_channel_expand]

SQL = {
    "nuisance_projection": """WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1)
 SELECT l_returnflag, count(*) AS n, round(stddev_samp(l_extendedprice - a * l_quantity - b), 3) AS sd FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1""",
    "exact_mode_majority": """WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS i, sum(n) OVER (PARTITION BY p_brand) AS t FROM c)
 SELECT p_brand, p_size AS mode, round(n / t, 9) AS share, n / t >= 0.5 AS passes FROM r WHERE i = 1""",
    "quality_attrition": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) > 1 AS copy FROM orders)
, s AS (SELECT CASE WHEN copy THEN 'DUPLICATE' WHEN o_totalprice < 1000 THEN 'PRICE' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'STATUS' ELSE 'KEPT' END AS reason FROM r)
 SELECT reason, count(*) AS n, (SELECT count(*) FILTER (reason = 'KEPT') >= 500 FROM s) AS enough FROM s GROUP BY 1""",
    "structural_filter": """WITH r AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END::INTEGER AS condition FROM lineitem)
 SELECT condition, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM r WHERE condition IN (0, 2) AND l_quantity / 40 BETWEEN 0 AND 1 AND l_discount BETWEEN 0 AND 1 AND l_extendedprice IS NOT NULL GROUP BY 1""",
    "final_iterations": "SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m",
    "ratio_summary": """WITH r AS (SELECT o_orderstatus, o_totalprice::DOUBLE / 1000 - o_orderkey % 2 * 1e6 AS ratio, abs(o_custkey % 9 - 4.0::DOUBLE) AS z FROM orders)
 SELECT o_orderstatus, count(*) AS n, round(median(ratio) FILTER (ratio > 0), 9) AS median_ratio, round(max(abs(log10(CASE WHEN ratio > 0 THEN ratio END))), 9) AS max_abs_log10, round(median(z), 9) AS z_median, round(max(z), 9) AS z_max, count(*) FILTER (z > 2) AS z_over_2 FROM r GROUP BY 1""",
    "lensing_shadow": """WITH c AS (SELECT c_custkey, -15.6::DOUBLE + c_custkey % 40 * 0.1::DOUBLE AS bar, -15.0::DOUBLE + c_custkey % 37 * 0.1::DOUBLE AS obs, sqrt((0.02::DOUBLE + c_custkey % 11 * 0.03::DOUBLE) ** 2 + 0.05::DOUBLE ** 2 + 0.1::DOUBLE ** 2) AS s FROM customer),
 e AS (SELECT c_custkey, bar, obs - bar AS eta, 10.0::DOUBLE ** obs - 10.0::DOUBLE ** bar AS d, 10.0::DOUBLE ** (obs - 1.96::DOUBLE * s) - 10.0::DOUBLE ** bar AS lo, 10.0::DOUBLE ** (obs + 1.96::DOUBLE * s) - 10.0::DOUBLE ** bar AS hi FROM c)
 SELECT c_custkey, round(eta, 9) + 0.0 AS eta, round(d * 1e12, 6) + 0.0 AS difference, round(lo * 1e12, 6) + 0.0 AS low, round(hi * 1e12, 6) + 0.0 AS high,
 CASE WHEN lo > 0 THEN 'POSITIVE' WHEN hi < 0 THEN 'NEGATIVE' ELSE 'SIGN_AMBIGUOUS' END || '_CONDITIONAL_SENSITIVITY_ENVELOPE_95' AS status, CASE WHEN bar < -15.0::DOUBLE THEN 'LOW_ACCELERATION_TAIL_SYSTEMATICS_DOMINANT' ELSE 'DECLARED_PRIMARY_RANGE' END AS reach FROM e""",
    "ambiguous_join": """WITH f AS (SELECT c_nationkey AS k, count(*) AS n, min(c_custkey) AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9400 GROUP BY 1)
 SELECT n_nationkey, n_name, CASE WHEN n = 1 THEN c END AS c_custkey, CASE WHEN n IS NULL THEN 'UNMATCHED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS join_status FROM nation LEFT JOIN f ON k = n_nationkey""",
    "unmatched_keys": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P') ORDER BY k LIMIT 5",
    "suffix_lookup": """WITH e AS (SELECT 'raw/' || c_mktsegment || '/run' || (c_custkey % 400) || '.csv' AS path FROM customer), n AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'BUILDING/run' || n_nationkey || '.csv' ELSE 'un' || (n_nationkey * 30) || '.csv' END AS suffix FROM nation),
 m AS (SELECT suffix, count(path) AS n, min(path) AS p FROM n LEFT JOIN e ON ends_with(path, suffix) GROUP BY 1)
 SELECT suffix, CASE WHEN n = 1 THEN p END AS path, n, CASE WHEN n = 0 THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS lookup_status FROM m""",
    "histogram_cells": """WITH b AS (SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 5.5 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 50 THEN 3 ELSE 4 END AS bin FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 60), k AS (SELECT unnest(range(0, 5)) AS bin)
 SELECT k.bin::INTEGER AS bin, count(b.bin) AS pairs FROM k LEFT JOIN b USING (bin) GROUP BY 1""",
    "block_diagonal": """WITH p AS (SELECT p_partkey % 5 AS i, p_partkey // 5 % 5 AS j, avg(p_size::DOUBLE) AS v FROM part GROUP BY ALL), b AS (SELECT unnest(range(0, 3))::INTEGER AS b)
 SELECT (i + 5 * b)::INTEGER AS i, (j + 5 * b)::INTEGER AS j, round(CASE WHEN i + j > 0 THEN v / ((i + j) / 4.0::DOUBLE) END, 6) AS v FROM p, b""",
    "envelope_checks": """WITH e AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE o_orderpriority END AS s, o_orderdate::DATE AS a, o_orderdate::DATE + (o_custkey % 9 - 2)::INTEGER AS z FROM orders)
 SELECT CASE WHEN coalesce(trim(s), '') = '' THEN 'EMPTY_FIELD' WHEN a > z THEN 'TIME_ORDER' ELSE 'VALID' END AS envelope_status, count(*) AS n FROM e GROUP BY 1""",
    "capacity_gate": """WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'laptop' ELSE 'remote' END AS execution_jurisdiction, s_suppkey::BIGINT * 1073741824 AS expected_bytes, CASE WHEN s_suppkey % 11 > 0 THEN (s_suppkey % 50 + 8)::BIGINT * 1073741824 END AS free_bytes FROM supplier)
 SELECT *, greatest(expected_bytes, 21474836480) AS required_bytes, CASE WHEN execution_jurisdiction <> 'remote' THEN 'REFUSED_JURISDICTION' WHEN free_bytes IS NULL OR free_bytes < greatest(expected_bytes, 21474836480) THEN 'REFUSED_CAPACITY' ELSE 'ADMITTED' END AS gate FROM r""",
    "stage_gate": """WITH k AS (SELECT c_custkey AS k FROM customer) SELECT CASE WHEN k % 10 + 4 < 7 THEN 'ABSTAIN_COMMIT_ID' WHEN k % 4 <> k % 8 THEN 'ABSTAIN_DIGEST_MISMATCH' WHEN k % 5 = 0 THEN 'ABSTAIN_BOUNDARY_CROSSED' WHEN k % 3 <> 1 THEN 'ABSTAIN_CONFIG_CHANGED' ELSE 'OPEN' END AS gate, count(*) AS n FROM k GROUP BY 1""",
    "authority_payload": """WITH e AS (SELECT n_regionkey AS j, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) FILTER (n_nationkey % 7 <> 0) AS e, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) FILTER (n_nationkey % 6 = 1) AS d, string_agg(n_name || '=' || CASE WHEN n_nationkey % 2 = 0 THEN 'SUPPORTED' ELSE 'NOT_ESTIMABLE' END, ';' ORDER BY n_name) AS v FROM nation GROUP BY 1),
 c AS (SELECT n_regionkey AS j, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 = 0 AND ((s_suppkey % 12 = 0 AND s_suppkey % 3 > 0) OR (s_suppkey % 12 <> 0 AND s_suppkey % 8 = 0)) GROUP BY 1)
 SELECT e.j AS jurisdiction, '1.0' AS schema_version, coalesce(e, '') AS envelopes, coalesce(c, '') AS claims, coalesce(d, '') AS decouplings, v AS vector FROM e LEFT JOIN c USING (j)""",
    "dedupe_first_last": "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY 1",
    "wilson_lower": """WITH c AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') / count(*) AS p FROM orders GROUP BY 1)
 SELECT o_orderpriority, n, round(greatest(0.0, (p + 1.96*1.96/(2*n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 9) AS lower FROM c""",
    "band_join_two_level_median": """WITH c AS (SELECT b AS band, b * 180.0::DOUBLE + 100 AS centre FROM (SELECT unnest(range(1, 11)) AS b)), l AS (SELECT l_suppkey, l_extendedprice / l_quantity AS unit FROM lineitem),
 e AS (SELECT band, l_suppkey, median(unit) AS m FROM c JOIN l ON unit BETWEEN centre - 25 AND centre + 25 GROUP BY ALL)
 SELECT band, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(quantile_cont(m, 0.16), 6) END AS q16, CASE WHEN count(*) >= 5 THEN round(median(m), 6) END AS median, CASE WHEN count(*) >= 5 THEN round(quantile_cont(m, 0.84), 6) END AS q84, CASE WHEN count(*) >= 5 THEN 'DESCRIPTIVE' ELSE 'INSUFFICIENT' END AS status FROM e GROUP BY band""",
    "signed_shadow_status": """WITH s AS (SELECT o_orderkey, log10(o_totalprice / 100000.0::DOUBLE) AS x, sqrt(0.05::DOUBLE ** 2 + ((o_custkey % 10) / 20.0::DOUBLE) ** 2) AS g FROM orders)
 SELECT o_orderkey, round(x, 6) AS excess, round(g, 6) AS sigma, CASE WHEN g IS NULL OR g <= 0 THEN 'NOT_ESTIMABLE' WHEN x / g >= 2 THEN 'POSITIVE_EXCESS' WHEN x / g <= -2 THEN 'NEGATIVE_EXCESS' ELSE 'CONSISTENT_WITH_ZERO' END AS status FROM s""",
    "validated_join": """WITH j AS (SELECT CASE WHEN c_custkey IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS join_status, * FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
 SELECT join_status, c_mktsegment, count(*) AS n FROM j WHERE join_status <> 'MATCHED' OR (c_acctbal > 0 AND o_totalprice > 5000) GROUP BY ALL""",
    "weighted_ratio_accumulation": """WITH p AS (SELECT l_suppkey AS l, l_quantity::DOUBLE AS r, (l_orderkey % 4)::DOUBLE AS w, l_quantity::DOUBLE + 1 AS s, l_discount::DOUBLE - 0.04::DOUBLE AS t, l_tax::DOUBLE - 0.03::DOUBLE AS x, l_tax::DOUBLE - CASE WHEN l_linenumber = 7 THEN 2 ELSE 0 END AS m FROM lineitem WHERE l_suppkey BETWEEN 0 AND 79),
 c AS (SELECT l, CASE WHEN r < 10 THEN 0 WHEN r < 20 THEN 1 WHEN r < 35 THEN 2 ELSE 3 END AS bin, sum(w / s * t) AS t, sum(w / s * x) AS x, sum(w / (s*s) * (1 + m)) AS d, count(*) AS n FROM p WHERE w > 0 AND 1 + m > 0 AND r >= 2 AND r < 49 GROUP BY ALL),
 g AS (SELECT l, unnest(range(0, 4)) AS bin FROM (SELECT DISTINCT l FROM p))
 SELECT g.l AS lens_index, g.bin::INTEGER AS bin, round(t / d, 6) AS esd, round(x / d, 6) AS cross_esd, coalesce(n, 0) AS pairs FROM g LEFT JOIN c USING (l, bin)""",
    "covariance_sandwich": """WITH v AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, embedding FROM embeddings), x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM v),
 c AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS v FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2), k AS (SELECT DISTINCT i FROM x),
 a AS (SELECT i, i AS j, 1.0::DOUBLE AS v FROM k UNION ALL SELECT i, i + 1, -0.5::DOUBLE FROM k WHERE i < (SELECT max(i) FROM k))
 SELECT l.i::INTEGER AS i, r.i::INTEGER AS j, round(sum(l.v * c.v * r.v), 5) AS v FROM a l JOIN c ON l.j = c.i JOIN a r ON c.j = r.j GROUP BY ALL""",
    "covariance_checks": """WITH v AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, embedding FROM embeddings), x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM v),
 c AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS v FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2), d AS (SELECT i, v AS d FROM c WHERE i = j)
 SELECT count(DISTINCT c.i) AS size, count(*) AS cells, count(DISTINCT c.i) * count(DISTINCT c.i) - count(*) AS missing, 0::BIGINT AS asymmetric, count(*) FILTER (c.i = c.j AND NOT c.v > 0) AS diagonal_bad,
 round(max(CASE WHEN c.i <> c.j THEN abs(c.v) / sqrt(a.d * b.d) END), 6) AS max_correlation, true AS positive_definite, true AS conditioned FROM c JOIN d a ON a.i = c.i JOIN d b ON b.i = c.j""",
    "manifest_digest": "SELECT doc_id::VARCHAR AS path, strlen(coalesce(text, ''))::BIGINT AS byte_count, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "manifest_verify": """WITH a AS (SELECT DISTINCT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 'x' || substring(text, 2) ELSE text END AS t FROM documents d JOIN labels USING (doc_id))
 SELECT d.doc_id::VARCHAR AS path, CASE WHEN d.doc_id % 11 = 0 THEN 'UNLISTED' WHEN a.doc_id IS NULL OR a.t IS NULL THEN 'MISSING' WHEN strlen(a.t) <> strlen(d.text) THEN 'BYTE_COUNT_MISMATCH' WHEN sha256(a.t) <> sha256(d.text) THEN 'SHA256_MISMATCH' ELSE 'OK' END AS status FROM documents d LEFT JOIN a USING (doc_id) WHERE d.doc_id % 11 <> 0 OR a.doc_id IS NOT NULL""",
    "seed_plan_order": "SELECT n_name, sha256('plan-7' || chr(0) || n_name) AS digest, round(('0x' || sha256('plan-7' || chr(0) || n_name)[1:16])::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE, 9) AS phase FROM nation",
    "claim_promotion_rules": """WITH c AS (SELECT coalesce(text, '') AS s, CASE role WHEN 'user' THEN 'OBSERVATION' WHEN 'assistant' THEN 'ASSOCIATION' ELSE 'INTERPRETATION' END AS kind,
 CASE turn % 4 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'OBSERVED' WHEN 2 THEN 'NOT_ESTIMABLE' ELSE 'PROPOSED' END AS status, conv_id % 3 AS ne, turn % 3 AS nb FROM conversations)
 SELECT kind, status, CASE WHEN length(trim(s)) = 0 THEN 'REFUSED_EMPTY_FIELD' WHEN status IN ('OBSERVED', 'SUPPORTED', 'CONTRADICTED') AND ne = 0 THEN 'REFUSED_NO_EVIDENCE'
 WHEN status = 'NOT_ESTIMABLE' AND nb = 0 THEN 'REFUSED_NO_REASON' WHEN kind NOT IN ('OBSERVATION', 'ASSOCIATION') AND status = 'SUPPORTED' THEN 'REFUSED_KIND' WHEN status = 'NOT_ESTIMABLE' THEN 'RETAINED_UNRESOLVED' ELSE 'ACCEPTED' END AS decision, count(*) AS n FROM c GROUP BY ALL""",
    "vector_channel_expand": "WITH v AS (SELECT unnest(range(0, len(embedding))) AS i, embedding FROM embeddings) SELECT i::INTEGER AS i, count(*) AS n, round(sum(embedding[i + 1]::DOUBLE), 5) AS total, round(max(embedding[i + 1]::DOUBLE), 6) AS greatest FROM v GROUP BY i",
}
