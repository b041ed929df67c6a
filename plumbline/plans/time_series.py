"""Queries over events: as-of joins, robust statistics, scans, nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import joins, nulls, ordered, pieces, robust, series

#: Seconds of a day: the ranges in which events are ordered.
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type, user_id, value, t (seconds) and hour and day (numbers since 1970)."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast(ts as timestamp_ntz))")
    return raw.select("event_id", "event_type", "user_id", "value", (micros / 1e6).alias("t"), F.floor(micros / 3.6e9).alias("hour"), F.floor(micros / 8.64e10).alias("day"))


_E = """e AS (SELECT event_id, event_type, user_id, value, epoch_us(ts) / 1e6 AS t,
  floor(epoch_us(ts) / 3.6e9)::BIGINT AS hour, floor(epoch_us(ts) / 8.64e10)::BIGINT AS day FROM events)"""


def asof_nearest_tolerance(spark, sf_dir):
    """Each click with the nearest error within 75 s."""
    e = _events(spark, sf_dir).select("event_id", "event_type", "t", "value")
    hit = joins.asof_nearest(e.where("event_type = 'click'"), e.where("event_type = 'error'").select("event_id", "t", "value"), 75.0, order="event_id")
    return hit.select("event_id", F.col("r_event_id").alias("error_id"), F.round(F.abs(F.col("t") - F.col("r_t")), 3).alias("gap_s"), F.round(F.col("value") - F.col("r_value"), 6).alias("difference"))


def asof_robust_slice(spark, sf_dir):
    """The as-of slice end to end: nearest errors, differences, finite rows, a robust summary for each day."""
    e = _events(spark, sf_dir).select("event_id", "event_type", "t", "day", "value")
    hit = joins.asof_nearest(e.where("event_type = 'click'"), e.where("event_type = 'error'").select("event_id", "t", "value"), 3600.0, order="event_id")
    out = hit.where("r_value IS NOT NULL").withColumn("d", F.col("value") - F.col("r_value")).withColumn("week", F.floor(F.col("day") / 7))
    return robust.residual_summary(out, "week", "d").select("week", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("beyond", 6).alias("beyond"))


def gap_aware_difference(spark, sf_dir):
    """Hourly means of each event type; differences only across adjacent hours."""
    hourly = _events(spark, sf_dir).groupBy("event_type", "hour").agg(F.avg("value").alias("v"))
    return ordered.gap_aware_difference(hourly, "event_type", "hour", "v", 1).select("event_type", "hour", F.round("difference", 6).alias("difference"))


def robust_residual_summary(spark, sf_dir):
    out = robust.residual_summary(_events(spark, sf_dir), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "mad", "skew", "kurtosis", "beyond", "k2", "p")])


def robust_scale_standardize(spark, sf_dir):
    return robust.standardise(_events(spark, sf_dir), "event_type", "value").select("event_id", F.round("z", 6).alias("z"))


def lag_correlation_scan(spark, sf_dir):
    """Daily means, clicks against purchases, lags -5 to 5."""
    daily = _events(spark, sf_dir).groupBy("event_type", F.col("day").alias("i")).agg(F.avg("value").alias("v"))
    part = lambda k: daily.where(F.col("event_type") == k).select("i", "v")
    return series.lag_scan(part("click"), part("purchase"), 5).select("lag", "n", F.round("r", 6).alias("r"))


def chronological_split(spark, sf_dir):
    return ordered.chronological_split(_events(spark, sf_dir), ["event_type"], ["t", "event_id"]).select("event_id", "subset")


def node_coverage_selection(spark, sf_dir):
    """Event types that are in every week, and have values in at least 98 % of all hours that have any."""
    cells = _events(spark, sf_dir).groupBy("event_type", "hour", F.floor(F.col("day") / 7).alias("week")).agg(F.avg("value").alias("v"))
    out = ordered.covered_nodes(cells.select(F.col("week").alias("segment"), F.col("hour").alias("epoch"), F.col("event_type").alias("node"), "v"), 0.98, 3)
    return out.select("node", "observed", "possible", F.round("coverage", 9).alias("coverage"), "selected", "enough")


def adaptive_grid(spark, sf_dir):
    """Median positive interval and Nyquist frequency of each event type."""
    out = ordered.cadence(_events(spark, sf_dir).select("event_type", "t", "event_id"), "event_type", ["t", "event_id"])
    return out.select("event_type", F.round("median_interval", 6).alias("median_s"), F.round("nyquist", 9).alias("nyquist_hz"))


def frequency_grid(spark, sf_dir):
    """Whole multiples of the events' resolution from 2e-5 Hz to 0.9 of the least Nyquist frequency, 5e-4 Hz at most."""
    e = _events(spark, sf_dir).select("event_type", "t", "event_id")
    grid = ordered.frequency_grid(ordered.cadence(e, "event_type", ["t", "event_id"]), e.agg(F.min("t").alias("start"), F.max("t").alias("stop")), 2e-5, 5e-4)
    return grid.select("k", F.round("frequency", 12).alias("frequency"))


def first_difference(spark, sf_dir):
    """Each event's value less the one before of its type, however long ago."""
    out = ordered.first_difference(_events(spark, sf_dir).select("event_id", "event_type", "t", "value"), ["event_type"], ["t", "event_id"], "value")
    return out.select("event_id", F.round("difference", 6).alias("difference"))


FREQUENCIES = [round(0.004 * k + 0.001, 6) for k in range(1, 17)]


def frequency_score_scan(spark, sf_dir):
    """Hourly means of all events at sixteen frequencies in cycles an hour."""
    hourly = _events(spark, sf_dir).groupBy("hour").agg(F.avg("value").alias("y")).withColumn("t", (F.col("hour") - 473000).cast("double"))
    return series.frequency_scores(hourly, "t", "y", FREQUENCIES).select("frequency", *[F.round(c, 5).alias(c) for c in ("a", "b", "power")])


def frequency_family(spark, sf_dir):
    """All events at 2,000 frequencies of an even grid, in cycles an hour."""
    rows = _events(spark, sf_dir).select((F.col("t") / 3600 - 473000).alias("t"), F.col("value").alias("y"))
    out = series.frequency_scores(rows, "t", "y", [k / 4000 for k in range(1, 2001)])
    return out.select(F.round("frequency", 9).alias("frequency"), *[F.round(c, 5).alias(c) for c in ("a", "b")], F.round("power", 3).alias("power"))


def _daily_pair(spark, sf_dir, a, b):
    daily = _events(spark, sf_dir).where(F.col("event_type").isin(a, b)).groupBy("day").agg(F.avg(F.when(F.col("event_type") == a, F.col("value"))).alias("x"), F.avg(F.when(F.col("event_type") == b, F.col("value"))).alias("y"))
    return daily.where("x IS NOT NULL AND y IS NOT NULL")


def block_coherence(spark, sf_dir):
    """Clicks against views by day in blocks of four days."""
    pair = _daily_pair(spark, sf_dir, "click", "view").withColumn("i", (F.col("day") - 19700).cast("double")).withColumn("block", F.floor(F.col("day") / 4))
    return series.block_coherence(pair, 8, 0.11).select(F.round("coherence", 6).alias("coherence"), "blocks")


def circular_rotation_null(spark, sf_dir):
    """All circular rotations of the daily click series against views: totals, and the rank p of no rotation. A row a day."""
    pair = _daily_pair(spark, sf_dir, "click", "view")
    indexed = pieces.numbered(pair.withColumn("g", F.lit(1)), ["g"], ["day"]).withColumn("i", F.col("i") - 1)
    totals = nulls.rotations(indexed, ["g"], "i", ["x"], "y").select("shift", F.round("x", 6).alias("total"))
    held = totals.where("shift = 0").select(F.col("total").alias("t0"))
    return totals.where("shift > 0").crossJoin(F.broadcast(held)).agg(F.count("*").alias("n"), F.round((1 + F.count_if(F.col("total") >= F.col("t0"))) / (F.count("*") + 1), 9).alias("rank_p"))


def local_maxima(spark, sf_dir):
    """Days on which a type's mean peaks."""
    daily = _events(spark, sf_dir).groupBy("event_type", "day").agg(F.avg("value").alias("v"))
    return ordered.local_maxima(daily, ["event_type"], "day", "v", 30.0).select("event_type", "day", F.round("v", 6).alias("v"))


def greedy_separated_topk(spark, sf_dir):
    """The eight strongest days of each type at least three days apart."""
    daily = _events(spark, sf_dir).groupBy("event_type", "day").agg(F.round(F.avg("value"), 6).alias("v"))
    return ordered.separated_top(daily, "event_type", "day", "v", 3.0, 8).select("event_type", "place", F.col("day").cast("long").alias("day"), "v")


def interpolating_lookup(spark, sf_dir):
    """Each type's value at every sixth hour, on the line between the events beside it."""
    e = _events(spark, sf_dir)
    first = e.groupBy("event_type", F.col("t")).agg(F.max("value").alias("value"))
    marks = e.select("event_type", (F.floor(F.col("hour") / 6) * 6 * 3600).cast("double").alias("t")).distinct()
    return joins.interpolate(marks, first, "t", "value", "event_type").select("event_type", F.col("t").cast("long").alias("t"), F.round("value", 4).alias("value"))


def daily_maximum_rank(spark, sf_dir):
    """For each type, the last day's maximum ranked among all other days' maxima."""
    daily = ordered.extremes_by_period(_events(spark, sf_dir), "event_type", "day", "value")
    return ordered.rank_of_last(daily, "event_type", "day").select("event_type", "n", F.round("rank_p", 9).alias("rank_p"))


def json_props(spark, sf_dir):
    """The numbers in the props JSON, summed by key."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(F.explode(F.from_json("props", "map<string,double>")).alias("key", "number")).groupBy("key").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


def reversal_counter(spark, sf_dir):
    """Rows whose value does not grow over the one before, in event order of each type."""
    return ordered.reversals(_events(spark, sf_dir), "event_type", "event_id", "value", 10_000.0)


def welch_psd(spark, sf_dir):
    hourly = _events(spark, sf_dir).groupBy("event_type", "hour").agg(F.avg("value").alias("v"))
    return series.welch(hourly, "event_type", "hour", "v").select("event_type", "k", F.round("density", 5).alias("density"))


def msc_coherence(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("hour").agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "view")])
    return series.coherence(e.withColumn("pair", F.lit("click-view")), "pair", "hour", "click", "view").select("pair", "k", F.round("coherence", 6).alias("coherence"))


def coherence_peak(spark, sf_dir):
    """The greatest coherence of two event types' hourly means over positive frequencies."""
    e = _events(spark, sf_dir).groupBy("hour").agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "purchase")])
    spectra = series.coherence(e.withColumn("pair", F.lit("click-purchase")), "pair", "hour", "click", "purchase")
    return series.greatest_coherence(spectra, "pair").select("pair", "k", F.round("coherence", 6).alias("coherence"), "bins")


def standardised_projection(spark, sf_dir):
    """Hourly means of clicks less their fit in standardised means of two other types, by week parity: the residuals' spread and the
    coefficients."""
    e = _events(spark, sf_dir).groupBy("hour").agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "view", "purchase")])
    rows = e.withColumn("parity", F.floor(F.col("hour") / 168) % 2)
    out, fits = series.project_standardised(rows, "parity", ["view", "purchase"], "click")
    spread = out.where("residual IS NOT NULL").groupBy("parity").agg(F.count("*").alias("n"), F.stddev_samp("residual").alias("sd"))
    betas = [F.round(F.col("beta")[i], 5).alias(n) for i, n in enumerate(("intercept", "b_view", "b_purchase"))]
    return spread.join(fits.drop("n"), "parity").select("parity", "n", F.round("sd", 5).alias("sd"), *betas)


def last_hours(spark, sf_dir):
    """Events of the last 48 hours by type."""
    return ordered.last_hours(_events(spark, sf_dir), "t", 48.0).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def separated_off_probes(spark, sf_dir):
    """The five strongest days of each type at least two days apart, none within a day and a half of two known days."""
    daily = _events(spark, sf_dir).groupBy("event_type", "day").agg(F.round(F.avg("value"), 6).alias("v"))
    out = ordered.separated_top(daily, "event_type", "day", "v", 2.0, 5, probes=[19730.0, 19741.0], probe_width=1.5, tolerance=1e-9)
    return out.select("event_type", "place", F.col("day").cast("long").alias("day"), "v")


def value_profile_width(spark, sf_dir):
    """Where the counts of each type's events by hour of day reach half of their greatest, over the last complete day of each."""
    hours = _events(spark, sf_dir).groupBy("event_type", "day", (F.col("hour") % 24).alias("h")).agg(F.count("*").alias("n"))
    return ordered.full_width(ordered.final_iteration(hours, ["event_type"], "day"), "event_type", "h", "n")


PLANS = [frequency_grid, first_difference, coherence_peak, standardised_projection, last_hours, separated_off_probes, value_profile_width, asof_nearest_tolerance, asof_robust_slice, gap_aware_difference, robust_residual_summary, robust_scale_standardize, lag_correlation_scan, chronological_split, node_coverage_selection, adaptive_grid, frequency_score_scan, frequency_family, block_coherence, circular_rotation_null, local_maxima, greedy_separated_topk, interpolating_lookup, daily_maximum_rank, json_props, reversal_counter, welch_psd, msc_coherence]

_NEAR = """c AS (SELECT * FROM e WHERE event_type = 'click'), r AS (SELECT * FROM e WHERE event_type = 'error'),
n AS (SELECT c.event_id, r.event_id AS error_id, abs(c.t - r.t) AS gap, c.value - r.value AS d, c.day,
      row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.t - r.t), r.t, CASE WHEN r.t <= c.t THEN -r.event_id ELSE r.event_id END) AS i FROM c JOIN r ON abs(c.t - r.t) <= {})"""
_DAILY = "p AS (SELECT day, avg(value) FILTER (event_type = '{}') AS x, avg(value) FILTER (event_type = '{}') AS y FROM e GROUP BY day), q AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL)"

#: D'Agostino's statistic of the groups of a table of rows.
_K2 = """k0 AS (SELECT {by}, count({v})::DOUBLE AS n, skewness({v}) * (count({v}) - 2) / sqrt(count({v})::DOUBLE * (count({v}) - 1)) AS g1, kurtosis({v}) AS kc FROM {rows} GROUP BY 1),
 k1 AS (SELECT *, (kc * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) AS g2 FROM k0),
 k3 AS (SELECT *, 3.0::DOUBLE * (n*n + 27*n - 70) * (n+1) * (n+3) / ((n-2) * (n+5) * (n+7) * (n+9)) AS b2, 3 * (n-1) / (n+1) AS ek, 24 * n * (n-2) * (n-3) / ((n+1) * (n+1) * (n+3) * (n+5)) AS vk,
   6 * (n*n - 5*n + 2) / ((n+7) * (n+9)) * sqrt(6 * (n+3) * (n+5) / (n * (n-2) * (n-3))) AS sk FROM k1),
 k4 AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / sk * (2 / sk + sqrt(1 + 4 / (sk*sk))) AS a FROM k3),
 k5 AS (SELECT *, g1 * sqrt((n+1) * (n+3) / (6 * (n-2))) / sqrt(2 / (w2 - 1)) AS y, 1 + (g2 + 3 - ek) / sqrt(vk) * sqrt(2 / (a - 4)) AS low FROM k4),
 k AS (SELECT {by}, (ln(y + sqrt(y*y + 1)) / sqrt(0.5 * ln(w2))) ** 2 + ((1 - 2 / (9*a) - sign(low) * cbrt((1 - 2/a) / abs(low))) / sqrt(2 / (9*a))) ** 2 AS k2 FROM k5)"""
#: Half-overlapping windowed segments of rows r (g, o, x) less their lines.
_SEGMENTS = """i AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM r WHERE x IS NOT NULL), l AS (SELECT g, regr_slope(x, i) AS a, regr_intercept(x, i) AS b FROM i GROUP BY 1),
 q AS (SELECT g, i, n, x - a * i - b AS x, (2 ** floor(log2(least({most}, n))))::BIGINT AS size FROM i JOIN l USING (g) WHERE n >= 16),
 t AS (SELECT g, x, size, s, i - s * (size // 2) AS j FROM q, LATERAL (SELECT unnest([i // (size // 2) - 1, i // (size // 2)]) AS s) WHERE s >= 0 AND s * (size // 2) + size <= n),
 wx AS (SELECT g, s, size, j, x, 0.5 - 0.5 * cos(2*pi()*j/size) AS w, sum((0.5 - 0.5 * cos(2*pi()*j/size)) ** 2) OVER (PARTITION BY g, s) AS w2 FROM t)"""
_SEGMENTS2 = """i AS (SELECT g, x, y, row_number() OVER (PARTITION BY g ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM r WHERE x IS NOT NULL AND y IS NOT NULL),
 l AS (SELECT g, regr_slope(x, i) AS a, regr_intercept(x, i) AS b, regr_slope(y, i) AS c, regr_intercept(y, i) AS d FROM i GROUP BY 1),
 q AS (SELECT g, i, n, x - a * i - b AS x, y - c * i - d AS y, (2 ** floor(log2(least(128, n))))::BIGINT AS size FROM i JOIN l USING (g) WHERE n >= 16),
 t AS (SELECT g, x, y, size, s, i - s * (size // 2) AS j FROM q, LATERAL (SELECT unnest([i // (size // 2) - 1, i // (size // 2)]) AS s) WHERE s >= 0 AND s * (size // 2) + size <= n),
 u AS (SELECT g, s, size, j, (x - avg(x) OVER (PARTITION BY g, s)) * (0.5 - 0.5 * cos(2*pi()*j/size)) AS x, (y - avg(y) OVER (PARTITION BY g, s)) * (0.5 - 0.5 * cos(2*pi()*j/size)) AS y FROM t),
 f AS (SELECT g, s, k, sum(x * cos(2*pi()*k*j/size)) AS xc, sum(x * sin(2*pi()*k*j/size)) AS xs, sum(y * cos(2*pi()*k*j/size)) AS yc, sum(y * sin(2*pi()*k*j/size)) AS ys FROM u, LATERAL (SELECT unnest(range(0, size // 2 + 1)) AS k) GROUP BY ALL),
 z AS (SELECT g, k, (sum(xc*yc + xs*ys) ** 2 + sum(xs*yc - xc*ys) ** 2) / (sum(xc*xc + xs*xs) * sum(yc*yc + ys*ys)) AS c FROM f GROUP BY ALL)"""
_MSC = "WITH {e}, r AS (SELECT '{a}-{b}' AS g, hour AS o, avg(value) FILTER (event_type = '{a}') AS x, avg(value) FILTER (event_type = '{b}') AS y FROM e GROUP BY hour), {s}"

SQL = {
    "asof_nearest_tolerance": f"WITH {_E}, {_NEAR.format(75)} SELECT c.event_id, error_id, round(gap, 3) AS gap_s, round(d, 6) AS difference FROM c LEFT JOIN (SELECT * FROM n WHERE i = 1) USING (event_id)",
    "asof_robust_slice": f"""WITH {_E}, {_NEAR.format(3600)}, w AS (SELECT floor(day / 7)::BIGINT AS week, d FROM n WHERE i = 1),
 m AS (SELECT week, median(d) AS median, mad(d) AS mad FROM w GROUP BY week)
 SELECT week, count(*) AS n, round(any_value(median), 6) AS median, round(any_value(mad), 6) AS mad,
 round(avg(CASE WHEN mad > 0 AND abs(d - median) > 3 * 1.4826 * mad THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS beyond FROM w JOIN m USING (week) GROUP BY week""",
    "gap_aware_difference": f"WITH {_E}, h AS (SELECT event_type, hour, avg(value) AS v FROM e GROUP BY ALL) SELECT a.event_type, a.hour, round(a.v - b.v, 6) AS difference FROM h a LEFT JOIN h b ON a.event_type = b.event_type AND b.hour = a.hour - 1",
    "robust_residual_summary": f"""WITH {_E}, m AS (SELECT event_type, median(value) AS md, mad(value) AS ma FROM e GROUP BY 1),
 {_K2.format(v="value", by="event_type", rows="e")}
 SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(any_value(md), 6) AS median, round(any_value(ma), 6) AS mad,
 round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurtosis, round(avg(CASE WHEN ma > 0 AND abs(value - md) > 3 * 1.4826 * ma THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS beyond, round(any_value(k2), 6) AS k2, round(exp(-any_value(k2) / 2), 6) AS p
 FROM e JOIN m USING (event_type) JOIN k USING (event_type) GROUP BY 1""",
    "robust_scale_standardize": f"""WITH {_E}, m AS (SELECT event_type, median(value) AS md, mad(value) AS ma, stddev_samp(value) AS sd FROM e GROUP BY 1)
 SELECT event_id, round((value - md) / CASE WHEN ma > 0 THEN 1.4826 * ma ELSE nullif(sd, 0) END, 6) AS z FROM e JOIN m USING (event_type)""",
    "lag_correlation_scan": f"""WITH {_E}, d AS (SELECT event_type, day, avg(value) AS v FROM e GROUP BY ALL), l AS (SELECT unnest(range(-5, 6)) AS lag)
 SELECT lag::INTEGER AS lag, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM l, d a JOIN d b ON a.event_type = 'click' AND b.event_type = 'purchase' WHERE b.day = a.day + lag GROUP BY lag HAVING count(*) >= 8""",
    "chronological_split": f"WITH {_E} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) <= floor(count(*) OVER (PARTITION BY event_type) * 0.4) THEN 'development' ELSE 'holdout' END AS subset FROM e",
    "node_coverage_selection": f"""WITH {_E}, h AS (SELECT count(DISTINCT hour) AS hs, count(DISTINCT floor(day / 7)) AS ws FROM e),
 n AS (SELECT event_type AS node, count(DISTINCT hour) AS observed, any_value(hs) AS possible FROM e, h GROUP BY 1 HAVING count(DISTINCT floor(day / 7)) = any_value(ws))
 SELECT node, observed, possible, round(observed / possible, 9) AS coverage, observed / possible >= 0.98 AS selected, count(*) FILTER (observed / possible >= 0.98) OVER () >= 3 AS enough FROM n""",
    "adaptive_grid": f"""WITH {_E}, s AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS dt FROM e), m AS (SELECT event_type, median(dt) AS m FROM s WHERE dt > 0 GROUP BY 1)
 SELECT event_type, round(m, 6) AS median_s, round(0.5 / m, 9) AS nyquist_hz FROM m""",
    "frequency_grid": f"""WITH {_E}, s AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS dt FROM e), m AS (SELECT event_type, median(dt) AS m FROM s WHERE dt > 0 GROUP BY 1),
 o AS (SELECT 1 / (SELECT max(t) - min(t) FROM e) AS step, least(5e-4::DOUBLE, 0.9::DOUBLE * min(0.5 / m)) AS top FROM m), k AS (SELECT unnest(range(ceil(2e-5::DOUBLE / step)::BIGINT, floor(top / step)::BIGINT + 1)) AS k, step FROM o)
 SELECT k, round(k * step, 12) AS frequency FROM k""",
    "first_difference": f"WITH {_E} SELECT event_id, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY t, event_id), 6) AS difference FROM e",
    "last_hours": f"WITH {_E}, m AS (SELECT max(t) AS m FROM e) SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM e, m WHERE t >= m - 48 * 3600 GROUP BY 1",
    "value_profile_width": f"""WITH {_E}, h AS (SELECT event_type, day, hour % 24 AS h, count(*) AS n FROM e GROUP BY ALL), l AS (SELECT *, max(day) OVER (PARTITION BY event_type) AS m FROM h), f AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS peak FROM l WHERE day = m)
 SELECT event_type, any_value(peak) AS peak, min(h) AS low, max(h) AS high, max(h) - min(h) AS width FROM f WHERE n >= 0.5 * peak GROUP BY 1""",
    "separated_off_probes": f"""WITH RECURSIVE {_E}, d AS (SELECT event_type, day, round(avg(value), 6) AS v FROM e GROUP BY ALL HAVING abs(day - 19730) >= 1.5 AND abs(day - 19741) >= 1.5),
 o AS (SELECT event_type, list({{'day': day, 'v': v}} ORDER BY v DESC, day) AS c FROM d GROUP BY 1),
 f AS (SELECT event_type, c, 1 AS step, [c[1]] AS chosen FROM o UNION ALL
       SELECT event_type, c, step + 1, CASE WHEN len(chosen) < 5 AND len(list_filter(chosen, lambda y: abs(y.day - c[step + 1].day) < 2)) = 0 THEN list_append(chosen, c[step + 1]) ELSE chosen END FROM f WHERE step < len(c)),
 z AS (SELECT event_type, chosen FROM f WHERE step = len(c)), u AS (SELECT event_type, unnest(range(1, len(chosen) + 1)) AS place, chosen FROM z)
 SELECT event_type, place::INTEGER AS place, chosen[place].day AS day, chosen[place].v AS v FROM u""",
    "standardised_projection": f"""WITH {_E}, h AS (SELECT hour, avg(value) FILTER (event_type = 'click') AS y, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'purchase') AS b FROM e GROUP BY 1),
 r AS (SELECT floor(hour / 168)::BIGINT % 2 AS parity, y, a, b FROM h WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
 m AS (SELECT parity, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, coalesce(nullif(stddev_samp(a), 0), 1) AS sa, coalesce(nullif(stddev_samp(b), 0), 1) AS sb FROM r GROUP BY 1),
 z AS (SELECT parity, y - my AS y, (a - ma) / sa AS a, (b - mb) / sb AS b, my FROM r JOIN m USING (parity)),
 g AS (SELECT parity, count(*) AS m, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS cy FROM z GROUP BY 1),
 c AS (SELECT parity, (bb*ay - ab*cy) / (aa*bb - ab*ab) AS ba, (aa*cy - ab*ay) / (aa*bb - ab*ab) AS b2 FROM g WHERE m > 3)
 SELECT parity, count(*) AS n, round(stddev_samp(y - ba * a - b2 * b), 5) AS sd, round(any_value(my), 5) AS intercept, round(any_value(ba), 5) AS b_view, round(any_value(b2), 5) AS b_purchase FROM z JOIN c USING (parity) GROUP BY 1""",
    "welch_psd": f"""WITH {_E}, r AS (SELECT event_type AS g, hour AS o, avg(value) AS x FROM e GROUP BY ALL), {_SEGMENTS.format(most=256)},
 f AS (SELECT g, s, size, k, sum(w * x * cos(2*pi()*k*j/size)) AS c, sum(w * x * sin(2*pi()*k*j/size)) AS d, any_value(w2) AS w2 FROM wx, LATERAL (SELECT unnest(range(0, size // 2 + 1)) AS k) GROUP BY ALL)
 SELECT g AS event_type, k::INTEGER AS k, round(avg((c*c + d*d) / w2 * CASE WHEN k = 0 OR k = size // 2 THEN 1 ELSE 2 END), 5) AS density FROM f GROUP BY 1, 2""",
    "msc_coherence": _MSC.format(e=_E, a="click", b="view", s=_SEGMENTS2) + " SELECT g AS pair, k::INTEGER AS k, round(c, 6) AS coherence FROM z",
    "coherence_peak": _MSC.format(e=_E, a="click", b="purchase", s=_SEGMENTS2) + " SELECT g AS pair, arg_min(k, (-round(c, 9), k))::INTEGER AS k, round(max(c), 6) AS coherence, count(*) AS bins FROM z WHERE k > 0 GROUP BY 1",
    "frequency_score_scan": f"""WITH {_E}, h AS (SELECT (hour - 473000)::DOUBLE AS t, avg(value) AS y FROM e GROUP BY hour), f AS (SELECT unnest({FREQUENCIES}::DOUBLE[]) AS frequency),
 w AS (SELECT frequency, y, cos(2 * pi() * frequency * t) AS c, sin(2 * pi() * frequency * t) AS s FROM h, f),
 g AS (SELECT frequency, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS ss, sum(c*y) AS cy, sum(s*y) AS sy FROM w GROUP BY 1),
 z AS (SELECT *, (ss*cy - cs*sy) / (cc*ss - cs*cs) AS a, (cc*sy - cs*cy) / (cc*ss - cs*cs) AS b FROM g WHERE cc*ss - cs*cs > 1e-9)
 SELECT frequency, round(a, 5) AS a, round(b, 5) AS b, round(a*cy + b*sy, 5) AS power FROM z""",
    "frequency_family": f"""WITH {_E}, h AS (SELECT t / 3600 - 473000 AS t, value AS y FROM e), f AS (SELECT unnest(range(1, 2001)) / 4000.0::DOUBLE AS frequency),
 w AS (SELECT frequency, y, cos(2 * pi() * frequency * t) AS c, sin(2 * pi() * frequency * t) AS s FROM h, f),
 g AS (SELECT frequency, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS ss, sum(c*y) AS cy, sum(s*y) AS sy FROM w GROUP BY 1),
 z AS (SELECT *, (ss*cy - cs*sy) / (cc*ss - cs*cs) AS a, (cc*sy - cs*cy) / (cc*ss - cs*cs) AS b FROM g WHERE cc*ss - cs*cs > 1e-9)
 SELECT round(frequency, 9) AS frequency, round(a, 5) AS a, round(b, 5) AS b, round(a*cy + b*sy, 3) AS power FROM z""",
    "block_coherence": f"""WITH {_E}, {_DAILY.format("click", "view")}, w AS (SELECT floor(day / 4) AS k, x, y, cos(2*pi()*0.11*(day-19700)) AS c, sin(2*pi()*0.11*(day-19700)) AS s FROM q),
 b AS (SELECT k, sum(x*c) AS xc, sum(x*s) AS xs, sum(y*c) AS yc, sum(y*s) AS ys FROM w GROUP BY k)
 SELECT round((sum(xc*yc+xs*ys)**2 + sum(xc*ys-xs*yc)**2) / (sum(xc*xc+xs*xs) * sum(yc*yc+ys*ys)), 6) AS coherence, count(*) AS blocks FROM b""",
    "circular_rotation_null": f"""WITH {_E}, {_DAILY.format("click", "view")}, i AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, x, y, count(*) OVER () AS n FROM q),
 t AS (SELECT s.shift, sum(a.x * b.y) AS total FROM i a, (SELECT i AS shift FROM i) s, i b WHERE b.i = (a.i + s.shift) % a.n GROUP BY 1)
 SELECT count(*) AS n, round((1 + count(*) FILTER (total >= (SELECT total FROM t WHERE shift = 0))) / (count(*) + 1), 9) AS rank_p FROM t WHERE shift > 0""",
    "local_maxima": f"""WITH {_E}, d AS (SELECT event_type, day, avg(value) AS v FROM e GROUP BY ALL), n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
 SELECT event_type, day, round(v, 6) AS v FROM n WHERE v >= l AND v > r""",
    "greedy_separated_topk": f"""WITH RECURSIVE {_E}, d AS (SELECT event_type, day, round(avg(value), 6) AS v FROM e GROUP BY ALL),
 o AS (SELECT event_type, list({{'day': day, 'v': v}} ORDER BY v DESC, day) AS c FROM d GROUP BY 1),
 f AS (SELECT event_type, c, 1 AS step, [c[1]] AS chosen FROM o UNION ALL
       SELECT event_type, c, step + 1, CASE WHEN len(chosen) < 8 AND len(list_filter(chosen, lambda y: abs(y.day - c[step + 1].day) < 3)) = 0 THEN list_append(chosen, c[step + 1]) ELSE chosen END FROM f WHERE step < len(c)),
 z AS (SELECT event_type, chosen FROM f WHERE step = len(c)), u AS (SELECT event_type, unnest(range(1, len(chosen) + 1)) AS place, chosen FROM z)
 SELECT event_type, place::INTEGER AS place, chosen[place].day AS day, chosen[place].v AS v FROM u""",
    "interpolating_lookup": f"""WITH {_E}, s AS (SELECT event_type, t, max(value) AS v FROM e GROUP BY ALL), m AS (SELECT DISTINCT event_type, (floor(hour / 6) * 21600)::DOUBLE AS t FROM e),
 a AS (SELECT m.event_type, m.t, lo.t AS lt, lo.v AS lv FROM m ASOF LEFT JOIN s lo ON m.event_type = lo.event_type AND m.t >= lo.t),
 b AS (SELECT a.*, hi.t AS ht, hi.v AS hv FROM a ASOF LEFT JOIN s hi ON a.event_type = hi.event_type AND a.t <= hi.t)
 SELECT event_type, t::BIGINT AS t, round(CASE WHEN lt = t THEN lv WHEN lt IS NOT NULL AND ht IS NOT NULL THEN lv + (hv - lv) * (t - lt) / (ht - lt) END, 4) AS value FROM b""",
    "daily_maximum_rank": f"""WITH {_E}, d AS (SELECT event_type, day, max(value) AS m FROM e GROUP BY ALL), l AS (SELECT event_type, max(day) AS ld, arg_max(m, day) AS lm FROM d GROUP BY 1)
 SELECT event_type, count(*) AS n, round((1 + count(*) FILTER (m >= lm)) / (count(*) + 1), 9) AS rank_p FROM d JOIN l USING (event_type) WHERE day < ld GROUP BY 1""",
    "json_props": "WITH k AS (SELECT props, unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n, sum(CAST(json_extract_string(props, key) AS DOUBLE)) AS total FROM k GROUP BY key",
    "reversal_counter": f"WITH {_E}, s AS (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS d FROM e) SELECT event_type, count(*) FILTER (d <= 0) AS reversals, count(*) AS n FROM s GROUP BY 1",
}
