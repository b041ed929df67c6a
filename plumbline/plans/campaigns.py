"""Network searches, profiled scans, nulls, power, time scales, typed verdicts."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import fringe, lens, network, nulls, pieces, points, sealed, series, shadow, verdicts
from plumbline.plans.time_series import _E, _SEGMENTS, _events
from plumbline.session import saved

VELOCITIES = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 2.0, 1.0), (0.5, 0.5, 0.0), (-1.0, 0.5, 0.0), (2.0, -1.0, 0.5), (-0.5, -0.5, 0.0), (3.0, 1.0, 0.0)]
BANDS = [0.011, 0.029, 0.0417, 0.083, 0.125, 0.21, 0.33, 0.41]
H0 = 473000


def _hourly(spark, sf_dir):
    """event_type, k (hours since a fixed one) and v, the hour's mean."""
    return _events(spark, sf_dir).groupBy("event_type", (F.col("hour") - H0).alias("k")).agg(F.avg("value").alias("v"))


def plane_wave_search(spark, sf_dir):
    """Event types as nodes of a network at places from their rank by name, hourly means as readings: the best centre of each of
    eight plane waves, all nodes required."""
    hourly = _hourly(spark, sf_dir)
    names = hourly.select(F.col("event_type").alias("node")).distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("node")).cast("double"))  # a row a node
    places = names.select("node", (3 * F.col("i")).alias("x"), (F.col("i") * F.col("i")).alias("y"), F.lit(1.0).alias("z"))
    weights = names.select("node", (1 / (1 + F.col("i"))).alias("w"))
    scores = network.surface(hourly.select(F.col("event_type").alias("node"), "k", F.col("v").alias("z")), network.delays(places, VELOCITIES), weights)
    return network.best_hit(scores, ("template",), digits=5).select("template", "centre", F.round("score", 5).alias("score"))


def profiled_frequency_scan(spark, sf_dir):
    """Eight frequencies against hourly means, each event type less its own mean and trend."""
    rows = _hourly(spark, sf_dir).select("event_type", F.col("k").cast("double").alias("t"), "v", F.lit(1.0).alias("one"), (F.col("k") / 1000.0).alias("u"))
    out = fringe.profiled_scores(rows, "event_type", "t", "v", ["one", "u"], BANDS)
    return out.select("frequency", *[F.round(c, 5).alias(c) for c in ("q_cos", "q_sin", "amplitude", "statistic")])


def nuisance_fit(spark, sf_dir):
    """Extended price by quantity and discount for each return flag."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("y"), F.lit(1.0).alias("one"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))
    out = fringe.fit_groups(li, "l_returnflag", "y", ["one", "q", "d"])
    return out.select("l_returnflag", "n", F.round(F.col("beta")[1], 3).alias("b_quantity"), F.round(F.col("beta")[2], 1).alias("b_discount"))


def daily_segments(spark, sf_dir):
    """Two blocks of two parts on each day with events, and how many events each part holds."""
    days = _events(spark, sf_dir).select(F.date_from_unix_date(F.col("day").cast("int")).alias("day")).distinct()
    parts = network.segments(days, ["02:00", "14:30"], [3600.0, 7200.0])
    held = _events(spark, sf_dir).select(F.date_from_unix_date(F.col("day").cast("int")).alias("day"), "t")
    out = parts.join(held, "day", "left").groupBy("label", "start", "stop").agg(F.count_if((F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop"))).alias("n"))
    return out.select("label", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "n")


def gps_time_scale(spark, sf_dir):
    """Event times as GPS seconds, and back."""
    e = _events(spark, sf_dir).select("event_id", "t").withColumn("gps", scalars.gps_second(F.col("t")))
    return e.select("event_id", F.round("gps", 3).alias("gps_s"), F.round(scalars.unix_second(F.col("gps")), 3).alias("unix_s"))


DRAWS = 60


def rotation_family_null(spark, sf_dir):
    """Sixty rotations of the event types' daily means against two waves, types independent: the greatest score of each."""
    daily = _events(spark, sf_dir).groupBy(F.col("event_type").alias("group"), "day").agg(F.avg("value").alias("r"))
    rows = pieces.numbered(daily, ["group"], ["day"]).drop("n").withColumn("i", F.col("i") - 1).withColumn("frequency", F.explode(F.array(F.lit(0.1), F.lit(0.23))))
    angle = 2 * np.pi * F.col("frequency") * F.col("i")
    signals = rows.select("group", "frequency", "i", F.cos(angle).alias("zc"), F.sin(angle).alias("zs"), "r")
    sizes = daily.groupBy("group").agg(F.count("*").alias("n"))
    shifts = sizes.select("group", "n", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw")).select("draw", "group", ((F.col("draw") * 37 + F.length("group") * 11) % (F.col("n") - 1) + 1).cast("long").alias("shift"))
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    grams = signals.groupBy("frequency").agg(dot("zc", "zc").alias("cc"), dot("zc", "zs").alias("cs"), dot("zs", "zs").alias("ss"))
    return nulls.rotation_null(signals, shifts, grams).select("draw", F.round("statistic", 4).alias("statistic"))


def family_rank_pvalues(spark, sf_dir):
    """Each supplier's balance ranked among the customers' of its nation, with the nation's 5 % critical value."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("family"), F.col("s_acctbal").cast("double").alias("statistic"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("family"), F.col("c_acctbal").cast("double").alias("statistic"))
    out = nulls.rank_pvalue(s, c).join(nulls.critical_value(c, 0.05), "family", "left")
    return out.select("s_suppkey", F.round("p", 9).alias("p"), F.round("critical", 4).alias("critical"))


def weighted_block_coefficients(spark, sf_dir):
    """Events of each type in eight equal blocks: the complex coefficient of the weighted residual at one frequency."""
    e = series.equal_blocks(_events(spark, sf_dir).select("event_type", "event_id", (F.col("t") / 3600 - H0).alias("h"), "value"), "h", 8)
    out = series.block_coefficients(e.withColumn("w", 1.0 + F.col("event_id") % 3), ["event_type", "block"], "h", "value", 0.05, weight="w", least=8)
    return out.select("event_type", "block", "n", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))


def allan_deviation(spark, sf_dir):
    """Overlapping Allan deviations of the event values of each type in order of arrival."""
    e = _events(spark, sf_dir)
    rows = pieces.numbered(e.select("event_type", "t", "event_id", "value"), ["event_type"], ["t", "event_id"])
    return series.allan_deviation(rows, "event_type", "i", "value", [1, 2, 4, 8]).select("event_type", "m", "n", F.round("deviation", 6).alias("deviation"))


def whittle_baseline(spark, sf_dir):
    """The likelihood of each event type's periodogram of hourly means under its own Welch density."""
    return series.whittle_baseline(_hourly(spark, sf_dir), "event_type", "k", "v").select("event_type", F.round("loglik", 4).alias("loglik"), "bins")


def periodogram(spark, sf_dir):
    """The one-sided periodogram of each event type's hourly means."""
    return series.periodogram(_hourly(spark, sf_dir), "event_type", "k", "v").select("event_type", F.round("frequency", 9).alias("frequency"), F.round("density", 4).alias("density"))


def injection_power(spark, sf_dir):
    """Detection and identification of injected waves in the hourly means of all events: one pass of sums of products."""
    bands = BANDS[:4]
    rows = _hourly(spark, sf_dir).groupBy("k").agg(F.avg("v").alias("y")).select(F.lit(0).alias("g"), "y", F.lit(1.0).alias("one"), *[f(2 * np.pi * b * F.col("k")).alias(f"{n}{i}") for i, b in enumerate(bands) for n, f in (("c", F.cos), ("s", F.sin))])
    columns = ["one", "y", *[f"{n}{i}" for i in range(len(bands)) for n in "cs"]]
    got = fringe.gram(rows, columns, "g").toPandas()  # as many rows as pairs of columns
    m = np.zeros((len(columns), len(columns)))
    m[got.i, got.j] = got.v
    m = m[1:, 1:] - np.outer(m[1:, 0], m[0, 1:]) / m[0, 0]
    score = m[1:, 0].reshape(-1, 2)
    cross = m[1:, 1:].reshape(len(bands), 2, len(bands), 2).transpose(0, 2, 1, 3)
    rms = float(np.sqrt(m[0, 0] / len(columns)))
    out = nulls.power_grid(spark, score, cross, bands, [0.1 * rms, 0.3 * rms, rms], critical=float(m[0, 0]) * 0.1)
    return out.select("frequency", F.round("amplitude", 5).alias("amplitude"), "detected", "identified")


def operator_status(spark, sf_dir):
    """Orders' prices as five versions of one quantity, judged."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("double") / 1000
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (p - k % 11 * 2).alias("exact"), (p + k % 3 - 4.0).alias("sis"), (p - k % 11 * 2 - k % 5).alias("zero"), (p - k % 11 * 2 + k % 4).alias("flat"), (p - k % 11 * 2 + k % 2).alias("quadratic"), (k % 6 * 1.0).alias("sigma"))
    return lens.operator_status(o).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("difference"), 2).alias("total"))


def input_recoverability(spark, sf_dir):
    """Parts as probed inputs, by state, with what the whole set comes to."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    probes = p.select(
        k,
        F.when(k % 13 == 0, 404).when(k % 2 == 0, 206).otherwise(200).alias("http_status"),
        (k * 10 + F.when(k % 7 == 0, 1).otherwise(0)).alias("observed_bytes"),
        (k * 10).alias("expected_bytes"),
        F.when(k % 5 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("c"))).alias("columns"),
        F.array(F.lit("c"), F.lit("a"), F.lit("b")).alias("required"),
        (k % 3).alias("rows"),
        F.when(k % 4 == 0, F.lit(0).cast("long")).alias("expected_rows"),
    )
    out = verdicts.probe_status(probes)
    return out.groupBy("probe_status").agg(F.count("*").alias("n"), F.sum("expected_bytes").alias("expected_bytes"), F.sum(F.size("missing")).cast("long").alias("missing"))


def recoverability_verdict(spark, sf_dir):
    """Suppliers as probed inputs: what all of them come to."""
    k = F.col("s_suppkey")
    columns = F.array(F.lit("a"), F.lit("b"))
    probes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k, F.lit(200).alias("http_status"), (k * 10).alias("observed_bytes"), (k * 10).alias("expected_bytes"), columns.alias("columns"), columns.alias("required"), (k % 3).alias("rows"), F.lit(None).cast("long").alias("expected_rows"))
    good = verdicts.recoverability(verdicts.probe_status(probes)).withColumn("inputs", F.lit("all"))
    drift = verdicts.recoverability(verdicts.probe_status(probes.withColumn("http_status", F.when(k % 90 == 0, 503).otherwise(206)))).withColumn("inputs", F.lit("one gone"))
    return good.unionByName(drift)


def cardinality_gate(spark, sf_dir):
    """Customers with enough orders to estimate from."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey")
    return verdicts.cardinality_gate(o, "o_custkey", 12)


def shrunk_covariance(spark, sf_dir):
    """The shrunk covariance of three columns of lineitem, and the network weights that follow from it."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") / 10).cast("double").alias("a"), (F.col("l_discount") * 20).cast("double").alias("b"), (F.col("l_extendedprice") / 20000).cast("double").alias("c"))
    c, shrinkage = shadow.ledoit_wolf(li, ["a", "b", "c"])
    w = network.covariance_weights(c)
    rows = [(i, j, float(c[i, j]), float(w[i]), float(shrinkage)) for i in range(3) for j in range(3)]
    out = spark.createDataFrame(rows, "i int, j int, v double, w double, shrinkage double")
    return out.select("i", "j", F.round("v", 6).alias("v"), F.round("w", 6).alias("w"), F.round(F.col("shrinkage") * 1e4, 5).alias("shrinkage_e4"))


def _network(spark, sf_dir):
    """values, places and weights of plane_wave_search()."""
    hourly = _hourly(spark, sf_dir)
    # a row a node
    names = hourly.select(F.col("event_type").alias("node")).distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("node")).cast("double"))
    places = names.select("node", (3 * F.col("i")).alias("x"), (F.col("i") * F.col("i")).alias("y"), F.lit(1.0).alias("z"))
    values = hourly.select(F.col("event_type").alias("node"), "k", F.col("v").alias("z"))
    return values, network.delays(places, VELOCITIES), names.select("node", (1 / (1 + F.col("i"))).alias("w"))


def injected_impulse(spark, sf_dir):
    """One wave's impulses added to the hourly means of the event types: which readings change, and the best hit of all templates."""
    values, delay, weights = _network(spark, sf_dir)
    struck = network.inject(values, delay, 3, 350.0, 500.0)
    changed = struck.withColumnRenamed("z", "y").join(values, ["node", "k"]).where(F.col("y") != F.col("z")).agg(F.count("*").alias("changed"), F.sum("k").alias("places"))
    best = network.best_hit(network.surface(struck, delay, weights), digits=5)
    return best.crossJoin(F.broadcast(changed)).select("changed", "places", F.round("statistic", 5).alias("statistic"), "centre", "template")  # one row


def injection_trials(spark, sf_dir):
    """Trials of impulses at all nodes: the best hit of each, from one surface."""
    values, delay, weights = _network(spark, sf_dir)
    trials = delay.where("template IN (1, 5)").select((F.col("template") * 10 + 1).alias("trial"), "node", (400 + F.col("delay")).alias("arrival"), (F.col("template") * 40.0).alias("amplitude"))
    out = network.injected_hits(values, delay, weights, trials)
    return out.select("trial", F.round("statistic", 5).alias("statistic"), "centre", "template")


#: Impulses of the power query, and the bank of the delays' query: templates, slowest and fastest speed, seed.
AMPLITUDES = [10.0, 100.0, 1000.0]
BANK = (256, 100.0, 600.0, 20260820)


def network_power(spark, sf_dir):
    """A wave of each amplitude at noon of each day, searched for in that day, against the best hits of all days: what is detected, what is found in
    time, and the gate."""
    values, delay, weights = _network(spark, sf_dir)
    means = values.groupBy("node").agg(F.avg("z").alias("m"))
    values = values.join(F.broadcast(means), "node").select("node", "k", (F.col("z") - F.col("m")).alias("z"))  # a row a node
    values, delay = saved(values, "values"), saved(delay, "delay")  # each is read many times
    days = values.select(F.floor(F.col("k") / 24).alias("day")).distinct()
    impulses = F.posexplode(F.array(*map(F.lit, AMPLITUDES))).alias("a", "amplitude")
    trials = days.select("day", impulses).select((F.col("day") * 10 + F.col("a")).alias("trial"), "amplitude", (F.col("day") * 24 + 12.0).alias("centre"), F.pmod("day", F.lit(8)).cast("int").alias("template"))
    arrivals = trials.join(F.broadcast(delay), "template").select("trial", F.floor(F.col("trial") / 10).alias("segment"), "node", (F.col("centre") + F.col("delay")).alias("arrival"), "amplitude")  # nodes by templates
    day = lambda centre: F.floor(centre / 24)
    hits = network.injected_hits(values, delay, weights, arrivals, segment=day)
    scores = network.surface(values, delay, weights).withColumn("day", day(F.col("centre")))
    exact = F.round("statistic", 6).alias("statistic")
    background = network.best_hit(scores, ("day",)).select(exact)
    out = network.power(hits.select("trial", exact, "centre"), trials, background, 0.1, 1.0)
    return out.select("amplitude", "trials", "detected", "localised", "joint", F.round("rate", 9).alias("rate"), F.round("lower", 9).alias("lower"), "gate")


def bank_delays(spark, sf_dir):
    """Suppliers as nodes: the span of the delays of each velocity of a scrambled Sobol bank."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    places = s.select(F.col("s_acctbal").cast("double").alias("x"), (F.col("s_suppkey") % 97 * 100.0).alias("y"), (F.col("s_nationkey") * 300.0).alias("z"))
    out = network.delay_spans(places, network.sobol_bank(spark, *BANK))
    return out.select("template", "nodes", *[F.round(c, 6).alias(c) for c in ("first", "last", "spread")])


def shrunk_vectors(spark, sf_dir):
    """The shrunk covariance of all components of the embeddings."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = v.agg(F.max(F.size("embedding"))).first()[0] or 1
    out = shadow.shrink_vectors(v, "embedding", size)
    return out.select("i", "j", F.round("v", 8).alias("v"), F.round(F.col("shrinkage") * 1e4, 5).alias("shrinkage_e4"))


def guarded_slices(spark, sf_dir):
    """Rows of half-open slices of hours without their guards, by type."""
    h = _hourly(spark, sf_dir)
    return network.guarded(h, "k", 100, 400, 12).groupBy("event_type").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


def block_permutation_null(spark, sf_dir):
    """The greatest coherence over two pairs of event types when the second one's blocks of days are moved on."""
    daily = _events(spark, sf_dir).groupBy("day", F.floor(F.col("day") / 3).alias("b")).agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "view", "purchase")])
    first = daily.agg(F.min("b").alias("b0"))
    rows = daily.crossJoin(F.broadcast(first)).withColumn("block", (F.col("b") - F.col("b0")).cast("int"))  # one row
    angle = 0.7 * F.col("day")
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col("click").alias("a"), F.col(n).alias("c")) for n in ("view", "purchase")]))
    wave = lambda v, f: F.sum(F.col(v) * f(angle))
    blocks = rows.select("block", "day", names.alias("r")).select("block", "day", "r.*").groupBy("name", "block").agg(wave("a", F.cos).alias("ar"), wave("a", F.sin).alias("ai"), wave("c", F.cos).alias("br"), wave("c", F.sin).alias("bi"))
    n = blocks.agg((F.max("block") + 1).alias("n"))
    moves = blocks.select("block").distinct().crossJoin(F.broadcast(n)).select("block", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("draw"))  # one row
    permutations = moves.select("draw", "block", ((F.col("block") + F.col("draw")) % F.col("n")).cast("int").alias("source"))
    return nulls.coherence_null(blocks, permutations, 4).select("draw", F.round("statistic", 6).alias("statistic"))


def claim_ledger(spark, sf_dir):
    """Conversation turns as claims, appended to a ledger that holds every third conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("-", "conv_id", "role").alias("claim_id"), "conv_id", F.struct("conv_id", "turn").alias("seq"), F.when(F.col("turn") % 5 == 4, "other").otherwise("ours").alias("jurisdiction"))
    ledger = c.where("conv_id % 3 = 0").select("claim_id")
    return verdicts.append_claims(ledger, c, "ours").groupBy("jurisdiction", "ledger_decision").agg(F.count("*").alias("n"))


def vector_status(spark, sf_dir):
    """Each nation's segments as channels, the status from the number of customers; the vector as text."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").agg(F.when(F.count("*") >= 10, "ESTIMABLE").otherwise("NOT_ESTIMABLE").alias("s"))
    out = verdicts.vector_status(c, "nation", "c_mktsegment", "s")
    return out.select("nation", F.array_join(F.transform(F.map_entries("channels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("channels"))


def interval_verdicts(spark, sf_dir):
    """Each nation's mean balance less 4500: its interval, and what may be said of it."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg((F.avg("c_acctbal") - 4500).alias("m"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("e"))
    out = c.select("c_nationkey", *verdicts.interval(F.col("m"), F.col("e")))
    state = verdicts.decide([(F.col("z").isNull(), "NOT_ESTIMABLE"), (F.col("includes_zero"), "CONSISTENT_WITH_ZERO"), (F.col("z") > 0, "ABOVE")], "BELOW")
    return out.select("c_nationkey", *[F.round(x, 4).alias(x) for x in ("low", "high", "z")], "includes_zero", state.alias("state"))


def winner_tiebreak(spark, sf_dir):
    """The day of the greatest revenue (rounded to thousands) by return flag, the earliest of equals."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_shipdate").agg(F.floor(F.sum("l_extendedprice") / 1000).alias("thousands"))
    return verdicts.winner(li, "l_returnflag", "thousands", "l_shipdate")


def scalar_kernels(spark, sf_dir):
    """Radii, snapped values, evidence, corrections and noise of customers."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey",
        F.round(scalars.fixed_acceleration_radius(1e10 * (k % 9), F.lit(1e-11)), 6).alias("radius_kpc"),
        scalars.snap(k % 100 / 40.0, [0.0, 0.5, 1.0, 2.0], 0.2).alias("snapped"),
        F.round(scalars.sign_evidence_bits(k % 21 / 20.0, F.lit(4096)), 9).alias("bits"),
        F.round(scalars.bias_corrected(F.col("c_acctbal").cast("double"), F.lit(0.03)), 6).alias("corrected"),
        F.round(scalars.scaled_noise(F.lit(0.0435), k % 500 + 1.0), 9).alias("noise"),
        F.round(scalars.unit_interval(k % 50 * 1.0, F.lit(0.0), F.lit(49.0)), 9).alias("u"),
        F.round(scalars.resolution_error(k % 7 / 10.0, F.lit(0.35), F.lit(12.0)), 9).alias("error"),
        scalars.seed_commitment(F.sha2(k.cast("string"), 256)).alias("commitment"),
        F.round(scalars.safe_divide(k * 1.0, k % 4 - 1.0), 9).alias("ratio"),
        F.round(scalars.turns_to_radians(k % 9 / 8.0), 9).alias("radians"),
        F.round(scalars.signed_square(k % 13 - 6.0), 9).alias("signed"),
    )


def text_kernels(spark, sf_dir):
    """Names of files, totals behind a slash, times with and without a zone."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("raw/"), k.cast("string"), F.lit("/"), F.col("c_name"), F.when(k % 3 == 0, "/").otherwise(".csv"))
    span = F.concat(F.lit("bytes 0-9"), F.when(k % 2 == 0, F.concat(F.lit("/"), k.cast("string"))).otherwise("/*"))
    zone = F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("+02:00"), F.lit("-0530"), F.lit(" no time")), (k % 5 + 1).cast("int"))
    t = scalars.utc(F.concat(F.lit("2024-03-10T0"), (k % 10).cast("string"), F.lit(":15:00"), zone))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", scalars.basename(path).alias("base"), scalars.range_total(span).alias("total"), scalars.iso(t).alias("at"), scalars.iso(scalars.unix_timestamp(k * 1000.25)).alias("unix"))


SEED = "9f" * 32


def sealed_plan(spark, sf_dir):
    """Regions as the labels of a challenge, the first without a signal: ids, order and phases from a seed."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("label"), F.when(F.col("r_regionkey") > 0, F.col("r_regionkey") * 0.01 + 0.02).alias("frequency"))
    return sealed.plan(r, SEED).select("case_id", "label", F.round("frequency", 6).alias("frequency"), F.round("phase", 9).alias("phase"))


def sealed_challenge(spark, sf_dir):
    """The challenge over hourly means: sealed, scanned without the plan, revealed."""
    hourly = _hourly(spark, sf_dir).groupBy("k").agg(F.avg("v").alias("v")).select(F.col("k").cast("double").alias("t"), "v", F.lit(1.0).alias("one"))
    bands = {f"band{i}": f for i, f in enumerate(BANDS[:4])}
    labels = spark.range(5).select(F.when(F.col("id") == 4, "null").otherwise(F.concat(F.lit("band"), F.col("id"))).alias("label"), F.get(F.array(*map(F.lit, bands.values())), F.col("id").cast("int")).alias("frequency"))
    hidden = sealed.plan(labels, SEED)
    cases = sealed.seal(hourly, hidden, "t", "v", 60.0)
    # one scan for all cases: each is a group of its own and stays apart
    scans = fringe.profiled_scores(cases.withColumn("g", F.col("case_id")), "g", "t", "v", ["one"], list(bands.values()), apart=("case_id",))
    best = verdicts.winner(scans, "case_id", "statistic", "frequency")
    names = F.element_at(F.create_map(*[F.lit(x) for f, n in ((f, n) for n, f in bands.items()) for x in (f, n)]), F.col("frequency"))
    strong = hourly.agg((F.var_samp("v") * 20).alias("cut"))
    said = best.crossJoin(F.broadcast(strong)).select("case_id", F.when(F.col("statistic") >= F.col("cut"), names).alias("predicted"))
    return sealed.reveal(said, hidden, SEED, hashlib.sha256(bytes.fromhex(SEED)).hexdigest())


PLANS = [recoverability_verdict, cardinality_gate, shrunk_covariance, injected_impulse, injection_trials, network_power, bank_delays, shrunk_vectors, guarded_slices, block_permutation_null, text_kernels, sealed_plan, sealed_challenge, plane_wave_search, profiled_frequency_scan, nuisance_fit, daily_segments, gps_time_scale, rotation_family_null, family_rank_pvalues, weighted_block_coefficients, allan_deviation, whittle_baseline, periodogram, injection_power, operator_status, input_recoverability, claim_ledger, vector_status, interval_verdicts, winner_tiebreak, scalar_kernels]

_H = f"{_E}, h AS (SELECT event_type, hour - {H0} AS k, avg(value) AS v FROM e GROUP BY ALL)"
_WAVES = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for i, (x, y, z) in enumerate(VELOCITIES))
_LEAP_DATES = "[1136073600, 1230768000, 1341100800, 1435708800, 1483228800]"

_NET = f"""{_H}, n AS (SELECT event_type AS node, row_number() OVER (ORDER BY event_type)::DOUBLE AS i FROM (SELECT DISTINCT event_type FROM h)),
 p AS (SELECT node, 1 / (1 + i) AS w, 3 * i - avg(3 * i) OVER () AS x, i * i - avg(i * i) OVER () AS y FROM n), f(template, vx, vy, vz) AS (VALUES {_WAVES}),
 d AS (SELECT node, template, w, (x * vx + y * vy) / (vx * vx + vy * vy + vz * vz) AS d FROM p, f)"""
#: The best hit of each trial: tables v (trial, node, k, v) and those of _NET.
_HIT = """s AS (SELECT a.trial, template, a.k - floor(d)::BIGINT AS centre, w * (a.v * (1 - (d - floor(d))) + b.v * (d - floor(d))) AS s FROM d JOIN v a USING (node) JOIN v b ON b.node = a.node AND b.trial = a.trial AND b.k = a.k + 1),
 g AS (SELECT trial, template, centre, sum(s) AS score FROM s GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM n)),
 b AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY {score} DESC, centre, template) AS r FROM g)"""
_SEALED = f"""bands AS (SELECT unnest({BANDS[:4]}::DOUBLE[]) AS f, unnest(range(0, 4)) AS i), l AS (SELECT 'band' || i AS label, f AS frequency FROM bands UNION ALL SELECT 'null', NULL), s AS (SELECT unhex('{SEED}') || unhex('00') AS s),
 o AS (SELECT label, frequency, s, row_number() OVER (ORDER BY sha256(s || encode('order:' || label))) - 1 AS i FROM l, s),
 plan AS (SELECT sha256(s || encode('case:' || i))[1:16] AS case_id, label, frequency, CASE WHEN frequency IS NOT NULL THEN 2 * pi() * (('0x' || sha256(s || encode('phase:' || label))[1:16])::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE) END AS phase FROM o)"""
_MATRIX, _SHIFT = points.scrambled(3, BANK[3])
_NUMBERS = ", ".join(f"({d}, {j}, {v})" for d in range(3) for j, v in enumerate(_MATRIX[d]))

SQL = {
    "network_power": f"""WITH {_NET}, z AS (SELECT event_type, k, v - avg(v) OVER (PARTITION BY event_type) AS v FROM h), days AS (SELECT DISTINCT floor(k / 24)::BIGINT AS day FROM h),
 t AS (SELECT day * 10 + a AS trial, (day % 8 + 8) % 8 AS template, day * 24 + 12 AS c, amplitude FROM days, (VALUES {", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(AMPLITUDES))}) q(a, amplitude)),
 hits AS (SELECT trial, node, ceil(c + d - 0.5)::BIGINT AS k, amplitude AS a FROM t JOIN d USING (template)), every AS (SELECT trial FROM t UNION ALL SELECT NULL::BIGINT),
 v AS (SELECT coalesce(every.trial, -99999) AS trial, event_type AS node, z.k, v + coalesce(a, 0) AS v FROM z CROSS JOIN every LEFT JOIN hits ON node = event_type AND hits.k = z.k AND hits.trial = every.trial),
 {_HIT.format(score="abs(score)")}, best AS (SELECT trial, arg_min(centre, ROW(-abs(score), centre, template)) AS centre, max(abs(score)) AS score FROM g WHERE floor(centre / 24) = floor(trial / 10) GROUP BY 1), null_days AS (SELECT floor(centre / 24) AS day, round(max(abs(score)), 6) AS s FROM g WHERE trial = -99999 GROUP BY 1),
 j AS (SELECT amplitude, (1 + (SELECT count(*) FROM null_days WHERE s >= round(abs(score), 6))) / ((SELECT count(*) FROM null_days) + 1)::DOUBLE <= 0.1 AS hit, abs(centre - c) <= 1 AS near FROM t LEFT JOIN best USING (trial)),
 o AS (SELECT amplitude, count(*) AS trials, count(*) FILTER (hit) AS detected, count(*) FILTER (near) AS localised, count(*) FILTER (hit AND near) AS joint FROM j GROUP BY 1),
 w AS (SELECT *, joint / trials AS p, 1.959963984540054::DOUBLE AS q FROM o), l AS (SELECT *, greatest(0, (p + q * q / (2 * trials) - q * sqrt(p * (1 - p) / trials + q * q / (4 * trials * trials))) / (1 + q * q / trials)) AS lower FROM w)
 SELECT amplitude, trials, detected, localised, joint, round(p, 9) AS rate, round(lower, 9) AS lower, (SELECT max_by(lower, amplitude) >= 0.8 FROM l) AS gate FROM l""",
    "bank_delays": f"""WITH m(d, j, v) AS (VALUES {_NUMBERS}), t AS (SELECT unnest(range(0, {BANK[0]})) AS template), s(d, shift) AS (VALUES {", ".join(f"({d}, {v})" for d, v in enumerate(_SHIFT))}),
 g AS (SELECT template, d, bit_xor(CASE WHEN (xor(template, template >> 1) >> j) & 1 = 1 THEN v ELSE 0 END) AS x FROM t, m GROUP BY ALL),
 u AS (SELECT template, max(xor(x::BIGINT, shift::BIGINT) / 1073741824.0::DOUBLE) FILTER (g.d = 0) AS a, max(xor(x::BIGINT, shift::BIGINT) / 1073741824.0::DOUBLE) FILTER (g.d = 1) AS b, max(xor(x::BIGINT, shift::BIGINT) / 1073741824.0::DOUBLE) FILTER (g.d = 2) AS c FROM g JOIN s USING (d) GROUP BY 1),
 w AS (SELECT template, exp(ln({BANK[1]}::DOUBLE) + a * (ln({BANK[2]}::DOUBLE) - ln({BANK[1]}::DOUBLE))) AS speed, 2 * b - 1 AS up, 2 * pi() * c AS turn FROM u),
 b AS (SELECT template, speed * sqrt(greatest(0, 1 - up * up)) * cos(turn) AS vx, speed * sqrt(greatest(0, 1 - up * up)) * sin(turn) AS vy, speed * up AS vz FROM w),
 p AS (SELECT s_acctbal::DOUBLE AS x, s_suppkey % 97 * 100.0::DOUBLE AS y, s_nationkey * 300.0::DOUBLE AS z FROM supplier), f AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
 o AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM f), e AS (SELECT template, ((x - mx) * vx + (y - my) * vy + (z - mz) * vz) / (vx * vx + vy * vy + vz * vz) AS d FROM f, o, b)
 SELECT template::BIGINT AS template, count(*) AS nodes, round(min(d), 6) AS first, round(max(d), 6) AS last, round(sqrt(avg(d * d)), 6) AS spread FROM e GROUP BY 1""",
    "shrunk_vectors": """WITH v AS (SELECT row_number() OVER () AS r, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings) AND len(list_filter(embedding, lambda q: q IS NOT NULL AND isfinite(q))) = len(embedding)),
 a AS (SELECT r, unnest(range(0, len(e))) AS i, unnest(e) AS x FROM v), m AS (SELECT i, avg(x) AS m FROM a GROUP BY 1), x AS (SELECT r, i, x - m AS x FROM a JOIN m USING (i)),
 c AS (SELECT l.i AS i, r.i AS j, avg(l.x * r.x) AS v FROM x l JOIN x r USING (r) GROUP BY 1, 2), q AS (SELECT avg(s * s) AS fourth, count(*) AS n FROM (SELECT r, sum(x * x) AS s FROM x GROUP BY 1)),
 k AS (SELECT sum(v * v) AS square, sum(v) FILTER (i = j) / count(*) FILTER (i = j) AS mu, count(*) FILTER (i = j) AS p FROM c), d AS (SELECT mu, (square - p * mu * mu) / p AS d2, (fourth - square) / p / n AS b2 FROM k, q),
 s AS (SELECT mu, CASE WHEN d2 <= 0 THEN 0 ELSE least(b2, d2) / d2 END AS k FROM d)
 SELECT i::INTEGER AS i, j::INTEGER AS j, round((1 - k) * v + CASE WHEN i = j THEN k * mu ELSE 0 END, 8) AS v, round(k * 1e4, 5) AS shrinkage_e4 FROM c, s""",
    "recoverability_verdict": """SELECT 'all' AS inputs, true AS all_verified, count(*) AS n, sum(s_suppkey * 10)::BIGINT AS expected_bytes, 'READY_ALL_INPUTS_VERIFIED' AS verdict FROM supplier
 UNION ALL SELECT 'one gone', count(*) FILTER (s_suppkey % 90 = 0) = 0, count(*), sum(s_suppkey * 10)::BIGINT, CASE WHEN count(*) FILTER (s_suppkey % 90 = 0) = 0 THEN 'READY_ALL_INPUTS_VERIFIED' ELSE 'NOT_READY_INPUT_FAILED_OR_DRIFTED' END FROM supplier""",
    "cardinality_gate": "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 12 THEN 'ESTIMABLE' ELSE 'NOT_ESTIMABLE' END AS status FROM orders GROUP BY 1",
    "shrunk_covariance": """WITH x AS (SELECT (l_quantity / 10)::DOUBLE AS a, (l_discount * 20)::DOUBLE AS b, (l_extendedprice / 20000)::DOUBLE AS c FROM lineitem), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, count(*) AS n FROM x), d AS (SELECT a - ma AS a, b - mb AS b, c - mc AS c, n FROM x, m),
 s AS (SELECT avg(a*a) AS aa, avg(a*b) AS ab, avg(a*c) AS ac, avg(b*b) AS bb, avg(b*c) AS bc, avg(c*c) AS cc, avg((a*a + b*b + c*c) ** 2) AS q, any_value(n) AS n FROM d),
 t AS (SELECT *, (aa + bb + cc) / 3 AS mu, aa*aa + bb*bb + cc*cc + 2 * (ab*ab + ac*ac + bc*bc) AS f FROM s), u AS (SELECT *, ((aa-mu)**2 + (bb-mu)**2 + (cc-mu)**2 + 2 * (ab*ab + ac*ac + bc*bc)) / 3 AS d2, (q - f) / 3 / n AS b FROM t),
 k AS (SELECT *, least(b, d2) / d2 AS k FROM u), z AS (SELECT k, (1-k)*aa + k*mu AS aa, (1-k)*ab AS ab, (1-k)*ac AS ac, (1-k)*bb + k*mu AS bb, (1-k)*bc AS bc, (1-k)*cc + k*mu AS cc FROM k),
 e AS (SELECT *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) AS det FROM z),
 w AS (SELECT *, ((bb*cc - bc*bc) - (ab*cc - bc*ac) + (ab*bc - bb*ac)) / det AS wa, (-(ab*cc - bc*ac) + (aa*cc - ac*ac) - (aa*bc - ab*ac)) / det AS wb, ((ab*bc - bb*ac) - (aa*bc - ab*ac) + (aa*bb - ab*ab)) / det AS wc FROM e),
 r AS (SELECT unnest([{'i': 0, 'j': 0, 'v': aa, 'w': wa}, {'i': 0, 'j': 1, 'v': ab, 'w': wa}, {'i': 0, 'j': 2, 'v': ac, 'w': wa}, {'i': 1, 'j': 0, 'v': ab, 'w': wb}, {'i': 1, 'j': 1, 'v': bb, 'w': wb}, {'i': 1, 'j': 2, 'v': bc, 'w': wb}, {'i': 2, 'j': 0, 'v': ac, 'w': wc}, {'i': 2, 'j': 1, 'v': bc, 'w': wc}, {'i': 2, 'j': 2, 'v': cc, 'w': wc}]) AS r, sqrt(wa + wb + wc) AS size, k FROM w)
 SELECT r.i AS i, r.j AS j, round(r.v, 6) AS v, round(r.w / size, 6) AS w, round(k * 1e4, 5) AS shrinkage_e4 FROM r""",
    "guarded_slices": f"WITH {_H} SELECT event_type, count(*) AS n, min(k) AS first, max(k) AS last FROM h WHERE k >= 112 AND k < 388 GROUP BY 1",
    "injected_impulse": f"""WITH {_NET}, hits AS (SELECT node, ceil(350 + d - 0.5)::BIGINT AS k FROM d WHERE template = 3), v AS (SELECT 1 AS trial, event_type AS node, h.k, v + CASE WHEN hits.k IS NULL THEN 0 ELSE 500 END AS v FROM h LEFT JOIN hits ON node = event_type AND hits.k = h.k),
 {_HIT.format(score="abs(round(score, 5))")} SELECT (SELECT count(*) FROM h JOIN hits ON node = event_type AND hits.k = h.k) AS changed, (SELECT sum(h.k)::BIGINT FROM h JOIN hits ON node = event_type AND hits.k = h.k) AS places, round(abs(score), 5) AS statistic, centre, template::INTEGER AS template FROM b WHERE r = 1""",
    "injection_trials": f"""WITH {_NET}, hits AS (SELECT template * 10 + 1 AS trial, node, ceil(400 + d - 0.5)::BIGINT AS k, template * 40.0::DOUBLE AS a FROM d WHERE template IN (1, 5)), t AS (SELECT DISTINCT trial FROM hits),
 v AS (SELECT t.trial, event_type AS node, h.k, v + coalesce(a, 0) AS v FROM h CROSS JOIN t LEFT JOIN hits ON node = event_type AND hits.k = h.k AND hits.trial = t.trial),
 {_HIT.format(score="abs(score)")} SELECT trial::INTEGER AS trial, round(abs(score), 5) AS statistic, centre, template::INTEGER AS template FROM b WHERE r = 1""",
    "block_permutation_null": f"""WITH {_E}, d AS (SELECT day, floor(day / 3)::BIGINT AS b, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS v, avg(value) FILTER (event_type = 'purchase') AS p FROM e GROUP BY day),
 r AS (SELECT 'view' AS name, day, b - min(b) OVER () AS block, a, v AS c FROM d UNION ALL SELECT 'purchase', day, b - min(b) OVER (), a, p FROM d),
 k AS (SELECT name, block, sum(a * cos(0.7 * day)) AS ar, sum(a * sin(0.7 * day)) AS ai, sum(c * cos(0.7 * day)) AS br, sum(c * sin(0.7 * day)) AS bi FROM r GROUP BY ALL), n AS (SELECT max(block) + 1 AS n FROM k), w AS (SELECT unnest(range(0, 8)) AS draw),
 j AS (SELECT draw, x.name, (sum(x.ar*y.br + x.ai*y.bi) ** 2 + sum(x.ar*y.bi - x.ai*y.br) ** 2) / (sum(x.ar*x.ar + x.ai*x.ai) * sum(y.br*y.br + y.bi*y.bi)) AS c, count(*) AS m FROM w, n, k x JOIN k y ON y.name = x.name AND y.block = (x.block + draw) % n GROUP BY ALL HAVING count(*) >= 4)
 SELECT draw::INTEGER AS draw, round(max(c), 6) AS statistic FROM j GROUP BY 1""",
    "text_kernels": """WITH k AS (SELECT c_custkey AS k, c_name, TIMESTAMP '2024-03-10 00:15:00' + INTERVAL 1 HOUR * (c_custkey % 10) AS t FROM customer)
 SELECT k AS c_custkey, CASE WHEN k % 3 = 0 THEN '' ELSE c_name || '.csv' END AS base, CASE WHEN k % 2 = 0 THEN k END::BIGINT AS total,
 CASE k % 5 WHEN 2 THEN strftime(t - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN strftime(t + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN NULL ELSE strftime(t, '%Y-%m-%dT%H:%M:%SZ') END AS at,
 strftime(make_timestamp((k * 1000.25 * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS unix FROM k""",
    "periodogram": f"""WITH {_H}, i AS (SELECT event_type AS g, v, row_number() OVER (PARTITION BY event_type ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM h), l AS (SELECT g, regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM i GROUP BY 1),
 f AS (SELECT g, k, any_value(n) AS n, sum((v - a*i - b) * cos(2*pi()*k*i/n)) AS c, sum((v - a*i - b) * sin(2*pi()*k*i/n)) AS s FROM i JOIN l USING (g), LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS k) GROUP BY ALL)
 SELECT g AS event_type, round(k / n, 9) AS frequency, round((c*c + s*s) / n * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END, 4) AS density FROM f WHERE n >= 16""",
    "whittle_baseline": f"""WITH {_H}, r AS (SELECT event_type AS g, k AS o, v AS x FROM h), {_SEGMENTS.format(most=256)},
 sf AS (SELECT g, s, size, k, sum(w * x * cos(2*pi()*k*j/size)) AS c, sum(w * x * sin(2*pi()*k*j/size)) AS d, any_value(w2) AS w2 FROM wx, LATERAL (SELECT unnest(range(0, size // 2 + 1)) AS k) GROUP BY ALL),
 psd AS (SELECT g, k, any_value(size) AS size, avg((c*c + d*d) / w2 * CASE WHEN k = 0 OR k = size // 2 THEN 1 ELSE 2 END) AS p FROM sf GROUP BY g, k),
 pf AS (SELECT g, k, any_value(n) AS n, sum(x * cos(2*pi()*k*i/n)) AS c, sum(x * sin(2*pi()*k*i/n)) AS s FROM q, LATERAL (SELECT unnest(range(1, n // 2 + 1)) AS k) GROUP BY ALL),
 ob AS (SELECT g, k / n AS f, (c*c + s*s) / n * CASE WHEN 2 * k = n THEN 1 ELSE 2 END AS o FROM pf),
 md AS (SELECT ob.g, ob.f, any_value(o) AS o, sum(p * greatest(0, 1 - abs(ob.f * size - psd.k))) AS m FROM ob JOIN psd ON psd.g = ob.g AND abs(ob.f * size - psd.k) < 1 + 1e-9 GROUP BY ALL)
 SELECT g AS event_type, round(-sum(ln(m) + o / m), 4) AS loglik, count(*) AS bins FROM md GROUP BY 1""",
    "injection_power": f"""WITH {_H}, y AS (SELECT k, avg(v) AS y FROM h GROUP BY k), bands AS (SELECT unnest({BANDS[:4]}::DOUBLE[]) AS f),
 z AS (SELECT f, k, y - avg(y) OVER (PARTITION BY f) AS y, cos(2*pi()*f*k) - avg(cos(2*pi()*f*k)) OVER (PARTITION BY f) AS c, sin(2*pi()*f*k) - avg(sin(2*pi()*f*k)) OVER (PARTITION BY f) AS s FROM y, bands),
 g AS (SELECT f, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS ss, sum(c*y) AS cy, sum(s*y) AS sy, (SELECT var_pop(y) * count(*) FROM y) AS yy FROM z GROUP BY f),
 x AS (SELECT a.f AS k, b.f AS f, sum(a.c*b.c) AS cc, sum(a.c*b.s) AS cs, sum(a.s*b.c) AS sc, sum(a.s*b.s) AS ss FROM z a JOIN z b USING (k) GROUP BY a.f, b.f),
 amp AS (SELECT unnest([0.1, 0.3, 1.0]::DOUBLE[]) AS m), ph AS (SELECT unnest(range(0, 16)) AS q),
 t AS (SELECT x.k, x.f, m * sqrt(yy / 10) AS a, q, yy, cy + m * sqrt(yy / 10) * (x.cc * cos(2*pi()*q/16) + x.cs * sin(2*pi()*q/16)) AS u, sy + m * sqrt(yy / 10) * (x.sc * cos(2*pi()*q/16) + x.ss * sin(2*pi()*q/16)) AS w, g.cc AS gc, g.cs AS gx, g.ss AS gs FROM x JOIN g ON g.f = x.k, amp, ph),
 st AS (SELECT k, f, a, q, yy, (gs*u*u - 2*gx*u*w + gc*w*w) / (gc*gs - gx*gx) AS v FROM t),
 r AS (SELECT f, a, q, any_value(yy) AS yy, max(v) FILTER (k = f) AS own, arg_max(k, v) AS best FROM st GROUP BY f, a, q)
 SELECT f AS frequency, round(a, 5) AS amplitude, count(*) FILTER (own >= 0.1 * yy) / 16 AS detected, count(*) FILTER (own >= 0.1 * yy AND best = f) / 16 AS identified FROM r GROUP BY f, a""",
    "sealed_challenge": f"""WITH {_H}, y AS (SELECT k::DOUBLE AS t, avg(v) AS v FROM h GROUP BY k), {_SEALED},
 c AS (SELECT case_id, t, v + coalesce(60 * cos(2*pi()*frequency*t - phase), 0) AS v FROM y, plan),
 z AS (SELECT case_id, f, v - avg(v) OVER (PARTITION BY case_id, f) AS y, cos(2*pi()*f*t) - avg(cos(2*pi()*f*t)) OVER (PARTITION BY case_id, f) AS c, sin(2*pi()*f*t) - avg(sin(2*pi()*f*t)) OVER (PARTITION BY case_id, f) AS s FROM c, bands),
 g AS (SELECT case_id, f, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS ss, sum(c*y) AS cy, sum(s*y) AS sy FROM z GROUP BY ALL), st AS (SELECT case_id, f, (ss*cy*cy - 2*cs*cy*sy + cc*sy*sy) / (cc*ss - cs*cs) AS v FROM g),
 w AS (SELECT case_id, arg_max(f, v) AS f, max(v) AS v FROM st GROUP BY 1), p AS (SELECT case_id, CASE WHEN v >= (SELECT 20 * var_samp(v) FROM y) THEN 'band' || i END AS predicted FROM w JOIN bands USING (f))
 SELECT case_id, label, predicted, CASE WHEN frequency IS NULL THEN CASE WHEN predicted IS NULL THEN 'CORRECT' ELSE 'FALSE_ALARM' END WHEN predicted IS NULL THEN 'MISSED' WHEN predicted = label THEN 'CORRECT' ELSE 'WRONG' END AS outcome FROM plan JOIN p USING (case_id)""",
    "sealed_plan": f"""WITH l AS (SELECT r_name AS label, CASE WHEN r_regionkey > 0 THEN r_regionkey * 0.01::DOUBLE + 0.02::DOUBLE END AS frequency FROM region), s AS (SELECT unhex('{SEED}') || unhex('00') AS s),
 o AS (SELECT label, frequency, s, row_number() OVER (ORDER BY sha256(s || encode('order:' || label))) - 1 AS i FROM l, s)
 SELECT sha256(s || encode('case:' || i))[1:16] AS case_id, label, round(frequency, 6) AS frequency, round(CASE WHEN frequency IS NOT NULL THEN 2 * pi() * (('0x' || sha256(s || encode('phase:' || label))[1:16])::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE) END, 9) AS phase FROM o""",
    "plane_wave_search": f"""WITH {_H}, n AS (SELECT event_type AS node, row_number() OVER (ORDER BY event_type)::DOUBLE AS i FROM (SELECT DISTINCT event_type FROM h)),
 p AS (SELECT node, 1 / (1 + i) AS w, 3 * i - avg(3 * i) OVER () AS x, i * i - avg(i * i) OVER () AS y FROM n), f(template, vx, vy, vz) AS (VALUES {_WAVES}),
 d AS (SELECT node, template, w, (x * vx + y * vy) / (vx * vx + vy * vy + vz * vz) AS d FROM p, f),
 s AS (SELECT template, a.k - floor(d)::BIGINT AS centre, w * (a.v * (1 - (d - floor(d))) + b.v * (d - floor(d))) AS s FROM d JOIN h a ON a.event_type = node JOIN h b ON b.event_type = node AND b.k = a.k + 1),
 g AS (SELECT template, centre, sum(s) AS score FROM s GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM n)),
 b AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY abs(round(score, 5)) DESC, centre) AS r FROM g)
 SELECT template::INTEGER AS template, centre, round(score, 5) AS score FROM b WHERE r = 1""",
    "profiled_frequency_scan": f"""WITH {_H}, r AS (SELECT event_type, k::DOUBLE AS t, k / 1000.0::DOUBLE AS u, v FROM h), f AS (SELECT unnest({BANDS}::DOUBLE[]) AS frequency),
 z AS (SELECT *, cos(2 * pi() * frequency * t) AS c, sin(2 * pi() * frequency * t) AS s FROM r, f),
 b AS (SELECT event_type, frequency, regr_slope(v, u) AS av, regr_intercept(v, u) AS bv, regr_slope(c, u) AS ac, regr_intercept(c, u) AS bc, regr_slope(s, u) AS sa, regr_intercept(s, u) AS sb FROM z GROUP BY ALL),
 q AS (SELECT frequency, v - av * u - bv AS y, c - ac * u - bc AS c, s - sa * u - sb AS s FROM z JOIN b USING (event_type, frequency)),
 g AS (SELECT frequency, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS ss, sum(c*y) AS cy, sum(s*y) AS sy FROM q GROUP BY 1),
 o AS (SELECT *, (ss*cy - cs*sy) / (cc*ss - cs*cs) AS q_cos, (cc*sy - cs*cy) / (cc*ss - cs*cs) AS q_sin FROM g WHERE cc*ss - cs*cs > 1e-12*cc*ss)
 SELECT frequency, round(q_cos, 5) AS q_cos, round(q_sin, 5) AS q_sin, round(sqrt(q_cos*q_cos + q_sin*q_sin), 5) AS amplitude, round(cy*q_cos + sy*q_sin, 5) AS statistic FROM o""",
    "nuisance_fit": """WITH r AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d FROM lineitem),
 m AS (SELECT l_returnflag, count(*) AS n, covar_pop(q, y) AS qy, covar_pop(d, y) AS dy, covar_pop(q, d) AS qd, var_pop(q) AS qq, var_pop(d) AS dd FROM r GROUP BY 1)
 SELECT l_returnflag, n, round((dd*qy - qd*dy) / (qq*dd - qd*qd), 3) AS b_quantity, round((qq*dy - qd*qy) / (qq*dd - qd*qd), 1) AS b_discount FROM m""",
    "daily_segments": f"""WITH {_E}, s(block, part, a, z) AS (VALUES (1, 1, 7200, 10800), (1, 2, 10800, 18000), (2, 1, 52200, 55800), (2, 2, 55800, 63000)),
 d AS (SELECT DISTINCT day FROM e), l AS (SELECT strftime(DATE '1970-01-01' + day::INTEGER, '%Y-%m-%d') || '-b' || block || '-p' || part AS label, day, day * 86400 + a AS start, day * 86400 + z AS stop FROM d, s)
 SELECT label, start::BIGINT AS start, stop::BIGINT AS stop, count(*) FILTER (t >= start AND t < stop) AS n FROM l LEFT JOIN e USING (day) GROUP BY ALL""",
    "gps_time_scale": f"WITH {_E} SELECT event_id, round(t - 946727987 + len(list_filter({_LEAP_DATES}, lambda s: t >= s)), 3) AS gps_s, round(t, 3) AS unix_s FROM e",
    "rotation_family_null": f"""WITH {_E}, d AS (SELECT event_type AS g, day, avg(value) AS r FROM e GROUP BY ALL), i AS (SELECT g, r, row_number() OVER (PARTITION BY g ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
 f AS (SELECT unnest([0.1, 0.23]::DOUBLE[]) AS f), z AS (SELECT *, cos(2*pi()*f*i) AS c, sin(2*pi()*f*i) AS s FROM i, f), m AS (SELECT f, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS ss FROM z GROUP BY f),
 w AS (SELECT unnest(range(0, {DRAWS})) AS draw), t AS (SELECT draw, z.f, sum(z.c * y.r) AS c, sum(z.s * y.r) AS s FROM w, z JOIN i y ON y.g = z.g AND y.i = (z.i + (draw * 37 + length(z.g) * 11) % (z.n - 1) + 1) % z.n GROUP BY ALL)
 SELECT draw::INTEGER AS draw, round(max((ss*c*c - 2*cs*c*s + cc*s*s) / (cc*ss - cs*cs)), 4) AS statistic FROM t JOIN m USING (f) GROUP BY draw""",
    "family_rank_pvalues": """WITH n AS (SELECT c_nationkey AS k, count(*) AS n, list(c_acctbal::DOUBLE ORDER BY c_acctbal DESC) AS v FROM customer GROUP BY 1)
 SELECT s_suppkey, round((1 + len(list_filter(v, lambda x: x >= s_acctbal::DOUBLE))) / (n + 1), 9) AS p, round(CASE WHEN floor(0.05 * (n + 1) - 1) >= 0 THEN v[floor(0.05 * (n + 1) - 1)::INTEGER + 1] END, 4) AS critical FROM supplier LEFT JOIN n ON k = s_nationkey""",
    "weighted_block_coefficients": f"""WITH {_E}, x AS (SELECT event_type, t / 3600 - {H0} AS h, value AS v, 1.0::DOUBLE + event_id % 3 AS w FROM e), o AS (SELECT min(h) AS lo, max(h) + 1e-6 AS hi FROM x),
 b AS (SELECT x.*, least(floor((h - lo) * 8 / (hi - lo)), 7)::INTEGER AS block FROM x, o WHERE v IS NOT NULL),
 m AS (SELECT event_type, block, sum(w*h)/sum(w) AS mh, sum(w*v)/sum(w) AS mv FROM b GROUP BY ALL),
 s AS (SELECT event_type, block, sum(w*(h-mh)*(v-mv)) / sum(w*(h-mh)*(h-mh)) AS slope FROM b JOIN m USING (event_type, block) GROUP BY ALL),
 r AS (SELECT event_type, block, h, w, v - mv - slope * (h - mh) AS r FROM b JOIN m USING (event_type, block) JOIN s USING (event_type, block))
 SELECT event_type, block, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN sum(w*r*cos(2*pi()*0.05*h)) / sqrt(sum(w)) END, 5) AS re, round(CASE WHEN count(*) >= 8 THEN -sum(w*r*sin(2*pi()*0.05*h)) / sqrt(sum(w)) END, 5) AS im FROM r GROUP BY ALL""",
    "allan_deviation": f"""WITH {_E}, i AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS i FROM e), m AS (SELECT unnest([1, 2, 4, 8]) AS m),
 p AS (SELECT event_type, i, sum(v) OVER (PARTITION BY event_type ORDER BY i) AS p FROM i UNION ALL SELECT DISTINCT event_type, 0, 0.0::DOUBLE FROM i)
 SELECT a.event_type, m::INTEGER AS m, count(*) AS n, round(sqrt(sum((c.p - 2 * b.p + a.p) ** 2) / (2 * m * m * count(*))), 6) AS deviation
 FROM m, p a JOIN p b ON b.event_type = a.event_type AND b.i = a.i + m JOIN p c ON c.event_type = a.event_type AND c.i = a.i + 2 * m GROUP BY a.event_type, m""",
    "operator_status": """WITH o AS (SELECT o_orderkey AS k, o_totalprice::DOUBLE / 1000 AS p FROM orders), v AS (SELECT p - k % 11 * 2 AS x, p + k % 3 - 4.0::DOUBLE AS s, p - k % 11 * 2 - k % 5 AS z, p - k % 11 * 2 + k % 4 AS f, p - k % 11 * 2 + k % 2 AS q, (k % 6)::DOUBLE AS g FROM o)
 SELECT CASE WHEN g <= 0 OR s <= 0 OR x <= 0 THEN 'NOT_ESTIMABLE_NONPOSITIVE_OR_DEGENERATE' WHEN greatest((greatest(x, z, f) - least(x, z, f)) / 2, abs(q - x)) >= abs(x - s) THEN 'OPERATOR_DIFFERENCE_UNRESOLVED_SYSTEMATICS'
 WHEN abs((x - s) / g) >= 1.96 THEN 'OPERATOR_DIFFERENCE_RESOLVED_CONDITIONAL_95' ELSE 'OPERATOR_DIFFERENCE_STATISTICALLY_UNRESOLVED_95' END AS status, count(*) AS n, round(sum(x - s), 2) AS total FROM v GROUP BY 1""",
    "input_recoverability": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS missing FROM part)
 SELECT CASE WHEN k % 13 = 0 THEN 'UNAVAILABLE_HTTP_STATUS' WHEN k % 7 <> 0 AND missing = 0 AND (k % 4 <> 0 OR k % 3 = 0) THEN 'AVAILABLE_SCHEMA_VERIFIED' ELSE 'AVAILABLE_SCHEMA_OR_SIZE_DRIFT' END AS probe_status, count(*) AS n, sum(k * 10)::BIGINT AS expected_bytes, sum(missing)::BIGINT AS missing FROM p GROUP BY 1""",
    "claim_ledger": """WITH c AS (SELECT conv_id || '-' || role AS claim_id, conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'other' ELSE 'ours' END AS jurisdiction FROM conversations),
 r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, jurisdiction ORDER BY conv_id, turn) AS i, claim_id IN (SELECT claim_id FROM c WHERE conv_id % 3 = 0) AS known FROM c)
 SELECT jurisdiction, CASE WHEN jurisdiction <> 'ours' THEN 'REFUSED_JURISDICTION' WHEN known OR i > 1 THEN 'REFUSED_DUPLICATE_ID' ELSE 'APPENDED' END AS ledger_decision, count(*) AS n FROM r GROUP BY ALL""",
    "vector_status": """WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS m, CASE WHEN count(*) >= 10 THEN 'ESTIMABLE' ELSE 'NOT_ESTIMABLE' END AS s FROM customer GROUP BY ALL)
 SELECT nation, string_agg(m || '=' || s, ';' ORDER BY m) AS channels FROM c GROUP BY nation""",
    "interval_verdicts": """WITH c AS (SELECT c_nationkey, avg(c_acctbal) - 4500 AS m, stddev_samp(c_acctbal) / sqrt(count(*)) AS e FROM customer GROUP BY 1)
 SELECT c_nationkey, round(m - 1.96 * e, 4) AS low, round(m + 1.96 * e, 4) AS high, round(CASE WHEN e > 0 THEN m / e END, 4) AS z, m - 1.96 * e <= 0 AND m + 1.96 * e >= 0 AS includes_zero,
 CASE WHEN e IS NULL OR e <= 0 THEN 'NOT_ESTIMABLE' WHEN m - 1.96 * e <= 0 AND m + 1.96 * e >= 0 THEN 'CONSISTENT_WITH_ZERO' WHEN m > 0 THEN 'ABOVE' ELSE 'BELOW' END AS state FROM c""",
    "winner_tiebreak": """WITH d AS (SELECT l_returnflag, l_shipdate, floor(sum(l_extendedprice) / 1000)::BIGINT AS thousands FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY thousands DESC, l_shipdate) AS i FROM d)
 SELECT l_returnflag, l_shipdate, thousands FROM r WHERE i = 1""",
    "scalar_kernels": """WITH k AS (SELECT c_custkey, c_custkey AS k, c_acctbal::DOUBLE AS b, (c_custkey % 100) / 40.0::DOUBLE AS x, (c_custkey % 21) / 20.0::DOUBLE AS p FROM customer),
 g AS (SELECT c_custkey, (list_sort(list_transform([0.0, 0.5, 1.0, 2.0]::DOUBLE[], lambda g: {'d': abs(x - g), 'g': g})))[1] AS s FROM k)
 SELECT c_custkey, round(CASE WHEN k % 9 > 0 THEN sqrt(6.67430e-11::DOUBLE * 1.98847e30::DOUBLE * 1e10::DOUBLE * (k % 9) / 1e-11::DOUBLE) / 3.085677581491367e19::DOUBLE END, 6) AS radius_kpc, CASE WHEN s.d <= 0.2 THEN s.g END AS snapped,
 round(0.0::DOUBLE - log2(greatest(2 * least(p, 1 - p), 1.0::DOUBLE / 4097)), 9) AS bits, round(b / 1.03, 6) AS corrected, round(0.0435 / sqrt((k % 500 + 1) / 141.0::DOUBLE), 9) AS noise, round(2 * (k % 50) / 49.0::DOUBLE - 1, 9) AS u,
 round(abs((k % 7) / 10.0::DOUBLE - 0.35) * 12, 9) AS error, sha256(unhex(sha256(k::VARCHAR))) AS commitment,
 round(CASE WHEN k % 4 > 1 THEN k / (k % 4 - 1) END, 9) AS ratio, round(2 * pi() * (k % 9) / 8, 9) AS radians, (k % 13 - 6)::DOUBLE * abs(k % 13 - 6) AS signed FROM k JOIN g USING (c_custkey)""",
}
