"""Feeds, token tables, headers and archives, written from the star tables and parsed again; curves selected and derived from them."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.functions import draws, scalars
from plumbline.operators import fringe, joins, shadow
from plumbline.plans.time_series import _E, _events
from plumbline.session import spread
from plumbline.sources import files, text


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts):
    """A line: the parts as texts, with single spaces."""
    return F.concat_ws(" ", *[p.cast("string") if hasattr(p, "cast") else F.lit(str(p)) for p in parts]).alias("value")


def header_feed(spark, sf_dir):
    """Suppliers as feeds of rows below a header, one for each nation: bad times and rows of other widths go, the last of equal times
    stays. Feeds of even nations have a propagated time too, which then counts, an hour after the other."""
    k, even = F.col("s_suppkey"), F.col("s_nationkey") % 2 == 0
    stamp = lambda hour: F.when(k % 9 == 0, "no time").otherwise(F.concat(F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("s_nationkey") * 86400), "yyyy-MM-dd"), F.lit(f" {hour}:"), F.lpad((k % 3).cast("string"), 2, "0"), F.lit(":00")))
    density = F.when(k % 7 == 0, "n/a").otherwise((k * 2).cast("string"))
    row = F.concat(F.array(stamp("00"), density, (k / 4.0).cast("string")), F.when(even, F.array(stamp("01"))).otherwise(F.array().cast("array<string>")))
    rows = _t(spark, sf_dir, "supplier").select("s_nationkey", F.struct(k.alias("k"), F.when(k % 11 == 0, F.slice(row, 1, 1)).otherwise(row).alias("r")).alias("x"))
    names = F.concat(F.array(F.lit("time_tag"), F.lit("density"), F.lit("speed")), F.when(even, F.array(F.lit("propagated_time_tag"))).otherwise(F.array().cast("array<string>")))
    feed = rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.concat(F.array(names), F.col("x.r")).alias("a"))
    out = text.header_rows(feed.select(F.to_json("a").alias("json")), ["density", "speed"], ["propagated_time_tag", "time_tag"])
    return out.select(scalars.iso(F.col("time")).alias("at"), "density", "speed")


def parallel_feed(spark, sf_dir):
    """Account balances of all customers as parallel arrays of two series, a feed for each hundred of a nation, in some of which the second is
    a value short; wide again."""
    c = _t(spark, sf_dir, "customer").select("c_nationkey", F.floor(F.col("c_custkey") / 100).alias("g"), F.struct("c_custkey", F.col("c_acctbal").cast("double").alias("b")).alias("x"))
    one = c.groupBy("c_nationkey", "g").agg(F.array_sort(F.collect_list("x")).alias("x"))
    values = F.transform("x", lambda x: x["b"])
    times = F.transform("x", lambda x: F.date_format(F.timestamp_seconds(F.lit(1706745600) + x["c_custkey"] * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    short = F.when(F.col("c_nationkey") % 5 == 0, F.slice(values, 1, F.size(values) - 1)).otherwise(F.transform(values, lambda v: v * 2))
    feed = one.select("c_nationkey", F.to_json(F.struct(times.alias("times"), F.array(F.struct(F.lit("X").alias("id"), values.alias("values")), F.struct(F.lit("Y").alias("id"), short.alias("values"))).alias("values"))).alias("json"))
    out = text.wide_series(text.parallel_series(feed), ["X", "Y"])
    return out.select(scalars.iso(F.col("time")).alias("at"), F.round("X", 2).alias("x"), F.round("Y", 2).alias("y"))


def described_feed(spark, sf_dir):
    """Parts as rows of a feed that describes its parameters, a vector among them; fill values become null."""
    k = F.col("p_partkey")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + k * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.when(k % 6 == 0, "-999.9").otherwise(F.col("p_size").cast("string"))
    vector = F.concat(F.lit("["), (k % 10).cast("string"), F.lit(","), F.when(k % 8 == 0, "1e31").otherwise((k % 7).cast("string")), F.lit("]"))
    data = _t(spark, sf_dir, "part").groupBy(F.floor(k / 256).alias("g")).agg(F.collect_list(F.when(k % 25 == 0, F.array(at, size)).otherwise(F.array(at, size, vector))).alias("d"))
    names = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("Time", "size", "B")])
    feed = data.select(F.to_json(F.struct(names.alias("parameters"), F.col("d").alias("data"))).alias("json"))
    out = text.fill_to_null(text.hapi_rows(feed, ["size", "B_0", "B_1"]), {"size": -999.9, "B_0": -1.0, "B_1": -1.0}, 1e30)
    return out.select(scalars.iso(F.col("time")).alias("at"), "size", "B_0", "B_1")


def merged_feeds(spark, sf_dir):
    """Clicks and errors as two feeds, merged to the nearest within 45 s: complete rows, the first of equal times."""
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'click'").select(F.floor("t").cast("double").alias("time"), F.col("event_id").alias("row"), F.col("value").alias("bz"))
    right = e.where("event_type = 'error'").select(F.floor("t").cast("double").alias("time"), F.col("event_id").alias("row"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("bz"))
    out = text.merge_nearest(left, joins.prefixed(right, "wind_", ("time", "row")), ["bz", "wind_bz"], 45.0, 60)
    return out.select(F.col("time").cast("long").alias("time"), F.round("bz", 6).alias("bz"), F.round("wind_bz", 6).alias("wind_bz"), "enough")


def _sample_lines(spark, sf_dir):
    """Suppliers as lines of 19 tokens; every tenth has one less, every seventh a distance that is no number."""
    k = F.col("s_suppkey")
    distance = F.when(k % 7 == 0, "nan").otherwise((k / 4.0).cast("string"))
    line = _text(F.concat(F.lit("G"), k), 5, distance, k / 100.0, 1, k % 60 + 20, k % 4 + 1, *[0] * 10, k % 4 + 1)
    return _t(spark, sf_dir, "supplier").select(F.concat(F.lit("  "), line, F.when(k % 10 == 0, "").otherwise(" ref")).alias("value"))


def _model_lines(spark, sf_dir):
    """Lines as radii of suppliers' curves: ten tokens each."""
    li = _t(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(_text(F.concat(F.lit("G"), F.col("l_suppkey") + 3), k % 9 + 1, F.col("l_linenumber") * 2 + k / 64.0, k % 200 - 8, k % 11, k % 30 - 5, k % 70, k % 13, 0, F.when(k % 17 == 0, "x").otherwise("0")))


def galaxy_table(spark, sf_dir):
    """The sample's parsed galaxies."""
    return text.rotation_sample(_sample_lines(spark, sf_dir))


def galaxy_doubles(spark, sf_dir):
    """Galaxies that stand more than once when the sample is read with a copy of some of its lines."""
    lines = _sample_lines(spark, sf_dir)
    twice = lines.unionByName(lines.where("value LIKE '%G1%'"))
    return text.doubled_keys(text.rotation_sample(twice), "galaxy")


def curve_table(spark, sf_dir):
    """Radii by galaxy: how many parse, and their extent."""
    m = text.mass_models(_model_lines(spark, sf_dir))
    return m.groupBy("galaxy").agg(F.count("*").alias("n"), F.round(F.min("radius"), 6).alias("least"), F.round(F.sum("v_obs"), 6).alias("total"))


def observation_selection(spark, sf_dir):
    """Radii that the cuts leave, with the squares of their speeds, what gas and stars make of them, and the closure cost."""
    points = shadow.select_observations(text.mass_models(_model_lines(spark, sf_dir)), text.rotation_sample(_sample_lines(spark, sf_dir)))
    out = shadow.nominal(points)
    return out.groupBy("galaxy").agg(F.count("*").alias("n"), F.round(F.sum("v_bar2"), 4).alias("v_bar2"), F.round(F.sum("delta_v2"), 4).alias("delta_v2"), F.round(F.max("closure_cost"), 6).alias("closure_cost"))


def curve_propagation(spark, sf_dir):
    """Quantiles over 4,096 draws of every selected radius' excess, added up by galaxy."""
    points = shadow.select_observations(text.mass_models(_model_lines(spark, sf_dir)), text.rotation_sample(_sample_lines(spark, sf_dir)))
    # a radius of the lines is a whole number of sixty-fourths
    sample = text.rotation_sample(_sample_lines(spark, sf_dir)).select("galaxy", "distance")
    q = shadow.propagate(points.drop("distance").join(sample, "galaxy"), point=F.col("radius") * 64)
    return q.groupBy("galaxy").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 2).alias(c) for c in ("q025", "q16", "q50", "q84", "q975")])


def clock_feed(spark, sf_dir):
    """Customers as clock lines of satellites, with other names, negative errors and bad numbers among them."""
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, ".Station.ABC.Clk.Bias").otherwise(F.concat(F.lit(".Satellite.GPS"), (k % 32 + 40), F.lit(".Clk.Bias")))
    line = _text(k * 30, 0, F.when(k % 10 == 0, "inf").otherwise((k / 8.0).cast("string")), F.when(k % 7 == 0, -1.0).otherwise(k / 16.0), name)
    return text.clock_lines(_t(spark, sf_dir, "customer").select(line)).groupBy("node").agg(F.count("*").alias("n"), F.sum("jpl_second").alias("seconds"), F.sum("bias_m").alias("bias"), F.sum("sigma_m").alias("sigma"))


def position_feed(spark, sf_dir):
    """Customers as position lines: E lines of satellites count."""
    k = F.col("c_custkey")
    line = _text(F.when(k % 5 == 0, "V").otherwise("E"), F.concat(F.when(k % 7 == 0, "GLO").otherwise("GPS"), k % 32 + 40), k * 300, 0, k / 2.0, -k, F.when(k % 9 == 0, "?").otherwise((k * 3).cast("string")))
    return text.position_lines(_t(spark, sf_dir, "customer").select(line)).groupBy("node").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("x_km", "y_km", "z_km")])


def commented_csv(spark, sf_dir):
    """Parts as CSV rows with comments, quotes and other widths."""
    k = F.col("p_partkey")
    row = F.concat((k / 2.0).cast("string"), F.lit(","), F.when(k % 3 == 0, F.concat(F.lit('"'), k.cast("string"), F.lit(',#5"'))).otherwise(k.cast("string")))
    lines = _t(spark, sf_dir, "part").select(F.when(k % 11 == 0, F.concat(F.lit("# "), row)).when(k == 1, "a,b,c").when(k % 5 == 0, row).otherwise(F.concat(row, F.lit(", 7"), F.when(k % 4 == 0, ",8").otherwise(""), F.lit(" # note, with commas"))).alias("value"))
    return text.comment_csv(lines, ["a", "b", "c"]).groupBy("width_ok").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"))


def named_tokens(spark, sf_dir):
    """Suppliers as a table of three tokens, with comments and words."""
    k = F.col("s_suppkey")
    lines = _t(spark, sf_dir, "supplier").select(F.when(k % 9 == 0, F.concat(F.lit(" # "), k.cast("string"))).when(k % 8 == 0, _text(k, "word", 1)).otherwise(_text(k, k / 4.0, k % 6)).alias("value"))
    return text.named_table(lines, ["key", "quarter", "rest"])


def profile_gate(spark, sf_dir):
    """Nations as a falling profile, and the same with one rise and one negative error."""
    k = F.col("n_nationkey")
    good = _t(spark, sf_dir, "nation").select(k.alias("row"), (100.0 - k * 2).alias("x"), (k + 1.0).alias("sigma"))
    bad = good.select("row", F.when(F.col("row") == 7, 99.0).otherwise(F.col("x")).alias("x"), F.when(F.col("row") == 3, -1.0).otherwise(F.col("sigma")).alias("sigma"))
    a, b = text.strict_profile(good, "x", "sigma", 25), text.strict_profile(bad, "x", "sigma", 25)
    return a.withColumn("profile", F.lit("falling")).unionByName(b.withColumn("profile", F.lit("broken")))


def header_cards(spark, sf_dir):
    """Suppliers as FITS headers of four cards."""
    card = lambda c: F.rpad(c, 80, " ")
    k = F.col("s_suppkey")
    head = F.concat(card(F.concat(F.lit("SIMPLE  =                    T / standard"))), card(F.concat(F.lit("NAXIS   = "), F.lpad(k.cast("string"), 20, " "))), card(F.concat(F.lit("OBJECT  = '"), F.col("s_name"), F.lit("' / name"))), card(F.lit("COMMENT no value")), card(F.lit("END")), card(F.lit("LATE    = 1")))
    return text.fits_cards(_t(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), head.cast("binary").alias("content")))


def array_files(spark, sf_dir):
    """Every embedding as a file of one array, read again: sums by place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from files.in_bytes(zip(batch.column("path").to_pylist(), packed(batch.column("embedding"))))

    def packed(vectors: pa.Array) -> Iterator[bytes]:
        for v in vectors:
            held = io.BytesIO()
            np.save(held, np.array(v.as_py() or [], np.float64))
            yield held.getvalue()

    made = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "embedding").mapInArrow(pack, "path string, content binary")
    return files.array_values(made).groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


def archives(spark, sf_dir):
    """Suppliers as archives of their nation's files: members and their sizes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from files.in_bytes(zip(batch.column("path").to_pylist(), packed(batch.column("k").to_pylist())))

    def packed(keys: list[int]) -> Iterator[bytes]:
        for k in keys:
            held = io.BytesIO()
            with tarfile.open(fileobj=held, mode="w") as archive:
                for i in range(k % 3 + 1):
                    info = tarfile.TarInfo(f"part{i}/{k}.txt")
                    info.size = k + i
                    archive.addfile(info, io.BytesIO(b"x" * (k + i)))
                archive.addfile(tarfile.TarInfo("link") if k % 2 else _folder())
            yield held.getvalue()

    def _folder() -> tarfile.TarInfo:
        info = tarfile.TarInfo("folder")
        info.type = tarfile.DIRTYPE
        return info

    made = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("path")).repartition(spread(spark), "k").mapInArrow(pack, "path string, content binary")
    return files.archive_members(made).where("byte_count > 0").select("path", "member", "byte_count")


def controlled_columns(spark, sf_dir):
    """What a discovery stage may read of customers, gathered in requested order."""
    allowed = {"discovery": ["c_custkey", "c_acctbal"], "confirmation": ["c_custkey", "c_acctbal", "c_mktsegment"]}
    open_ = files.select_allowed(_t(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal"], allowed, "discovery").withColumnRenamed("c_custkey", "row_id")
    wanted = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("row_id"))
    return files.gather(wanted, open_).select("place", "row_id", "c_acctbal")


def fringe_fit(spark, sf_dir):
    """Hourly means by event type in terms of a slow time and a daily phase: what the fit leaves of the sum of squares, and the
    fit's slope in phase at one place."""
    h = _events(spark, sf_dir).groupBy("event_type", "hour").agg(F.avg("value").alias("v"))
    u, phi = (F.col("hour") - 473300) / 400.0, scalars.turns_to_radians(F.col("hour") % 24 / 24.0)
    names = ["one", "u", "c", "s", "uc", "us"]
    rows = h.select("event_type", "v", *[t.alias(n) for t, n in zip(fringe.nuisance_terms(u, phi), names)])
    fits = fringe.fit_groups(rows, "event_type", "v", names)
    beta = [F.col("beta")[i] for i in range(6)]
    left = F.col("v") - sum(b * F.col(n) for b, n in zip(beta, names))
    both = rows.join(fits.drop("n"), "event_type").groupBy("event_type", "beta").agg(F.count("*").alias("n"), F.sum(left * left).alias("rss"))
    return both.select("event_type", "n", F.round("rss", 3).alias("rss"), F.round(fringe.fringe_slope(beta, F.lit(0.25), F.lit(1.0)), 5).alias("slope"))


def phase_proxy(spark, sf_dir):
    """Orders as two arms with coefficients, residuals and scales: rows with little information go."""
    k = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (k % 17 - 8.0).alias("c1"), (k % 5 - 2.0).alias("r1"), (k % 3 + 1.0).alias("s1"), (k % 11 - 5.0).alias("c2"), (k % 7 - 3.0).alias("r2"), F.lit(2.0).alias("s2"))
    out = fringe.phase_proxy(o, "o_orderstatus", [("c1", "r1", "s1"), ("c2", "r2", "s2")], 0.1)
    return out.select("o_orderkey", (F.round("phase", 9) + 0.0).alias("phase"), F.round("information", 9).alias("information"))


def quadrature_signals(spark, sf_dir):
    """Signals of two arms of opposite sign from each type's first event on: their sums of products with the values."""
    e = _events(spark, sf_dir).select("event_type", "value", (F.col("t") / 3600).alias("h"), F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0).alias("sign")).withColumn("f", F.lit(0.05))
    out = fringe.quadrature_signals(e, ["event_type"], "h", "f", F.col("sign"))
    return out.groupBy("event_type").agg(F.round(F.sum(F.col("zc") * F.col("value")), 4).alias("c"), F.round(F.sum(F.col("zs") * F.col("value")), 4).alias("s"))


def unix_times(spark, sf_dir):
    """Event times as Unix seconds by the library's own expression, and back to a timestamp's text."""
    e = _t(spark, sf_dir, "events").select("event_id", scalars.seconds(F.col("ts")).alias("t"))
    return e.select("event_id", F.round("t", 6).alias("t"), F.date_format(scalars.unix_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


PLANS = [
    header_feed, parallel_feed, described_feed, merged_feeds, galaxy_table, galaxy_doubles, curve_table, observation_selection, curve_propagation, clock_feed,
    position_feed, commented_csv, named_tokens, profile_gate, header_cards, array_files, archives, controlled_columns, fringe_fit, phase_proxy, quadrature_signals, unix_times,
]

_SAMPLE = """sl AS (SELECT 'G' || s_suppkey AS galaxy, s_suppkey / 4.0::DOUBLE AS distance, s_suppkey / 100.0::DOUBLE AS distance_error, (s_suppkey % 60 + 20)::DOUBLE AS inclination, (s_suppkey % 4 + 1)::DOUBLE AS inclination_error, (s_suppkey % 4 + 1)::DOUBLE AS quality
 FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey % 7 <> 0)"""
_MODELS = """ml AS (SELECT 'G' || (l_suppkey + 3) AS galaxy, l_linenumber * 2 + l_orderkey / 64.0::DOUBLE AS radius, (l_orderkey % 200 - 8)::DOUBLE AS vo, (l_orderkey % 11)::DOUBLE AS ve, (l_orderkey % 30 - 5)::DOUBLE AS vg, (l_orderkey % 70)::DOUBLE AS vd, (l_orderkey % 13)::DOUBLE AS vb FROM lineitem WHERE l_orderkey % 17 <> 0)"""
_CUTS = "quality <= 2 AND inclination >= 30 AND radius > 0 AND vo > 0 AND ve > 0 AND ve / abs(vo) <= 0.10"


def _philox(table, keep, a, b, c, d):
    """Rows of a table with the generator's four words a, b, c, d0 of a counter, the key being 10 and its column k."""
    out, keys = f"SELECT {keep}, {a} AS a, {b} AS b, {c} AS c, {d} AS d0, k AS k1 FROM {table}", (10, 0)
    for _ in range(draws.ROUNDS):
        p, q = f"(a * {draws.MULTIPLIERS[0]})", f"(c * {draws.MULTIPLIERS[1]})"
        out = f"SELECT {keep}, xor(xor({q} >> 32, b), {keys[0]}::UBIGINT) AS a, {q} & 4294967295 AS b, xor(xor({p} >> 32, d0), k1) AS c, {p} & 4294967295 AS d0, (k1 + {draws.STEPS[1]}) & 4294967295 AS k1 FROM ({out})"
        keys = ((keys[0] + draws.STEPS[0]) & 0xFFFFFFFF, 0)
    return out


def _uniform(high, low):
    return f"((({high} >> 5)::DOUBLE * 67108864 + ({low} >> 6)::DOUBLE + 0.5) / 9007199254740992)"


def _inverse(p):
    """The normal inverse of p."""

    def poly(x, coefficients):
        out = repr(coefficients[-1]) + "::DOUBLE"
        for k in reversed(coefficients[:-1]):
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    ratio = lambda x, t: f"({poly(x, t[0])} / {poly(x, t[1])})"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(f'(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))', draws.MIDDLE)} ELSE sign({p} - 0.5) * CASE WHEN {r} <= 5 THEN {ratio(f'({r} - 1.6)', draws.TAIL)} ELSE {ratio(f'({r} - 5)', draws.FAR)} END END)"


#: r1 to r6: rows less what their terms t0, t1, ... explain, one term after another, each less what the ones before explain. A row that is not of the
#: data takes no part in the sums, so that with v = 0 its end is the fit at its terms, with the other sign.
_ORTHOGONAL = ", ".join(
    f"r{j + 1} AS (SELECT event_type, is_row, "
    + ", ".join(f"{c} - t{j} * sum({c} * t{j}) FILTER (is_row) OVER (PARTITION BY event_type) / sum(t{j} * t{j}) FILTER (is_row) OVER (PARTITION BY event_type) AS {c}" for c in ["v", *[f"t{i}" for i in range(j + 1, 6)]])
    + f" FROM r{j})"
    for j in range(6)
)
_STAMP = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
SQL = {
    "header_feed": f"""WITH l AS (SELECT 1704067200 + s_nationkey * 86400 + (1 - s_nationkey % 2) * 3600 + s_suppkey % 3 * 60 AS m, max(s_suppkey) AS k FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 11 <> 0 GROUP BY 1)
 SELECT {_STAMP.format("m")} AS at, CASE WHEN k % 7 > 0 THEN k * 2 END::DOUBLE AS density, k / 4.0::DOUBLE AS speed FROM l""",
    "parallel_feed": f"""SELECT {_STAMP.format("(1706745600 + c_custkey * 60)")} AS at, round(c_acctbal::DOUBLE, 2) AS x, round(CASE WHEN c_nationkey % 5 > 0 THEN 2 * c_acctbal::DOUBLE END, 2) AS y FROM customer""",
    "described_feed": f"""SELECT {_STAMP.format("(1704067200 + p_partkey * 60)")} AS at, CASE WHEN p_partkey % 6 > 0 THEN p_size END::DOUBLE AS size, (p_partkey % 10)::DOUBLE AS B_0, CASE WHEN p_partkey % 8 > 0 THEN p_partkey % 7 END::DOUBLE AS B_1 FROM part WHERE p_partkey % 25 <> 0""",
    "merged_feeds": f"""WITH {_E}, c AS (SELECT floor(t) AS t, event_id, value FROM e WHERE event_type = 'click'), r AS (SELECT floor(t) AS t, event_id, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM e WHERE event_type = 'error'),
 n AS (SELECT c.t, c.event_id, c.value AS bz, r.value AS speed, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.t - r.t), r.t, CASE WHEN r.t <= c.t THEN -r.event_id ELSE r.event_id END) AS i FROM c JOIN r ON abs(c.t - r.t) <= 45),
 f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY event_id) AS j FROM n WHERE i = 1 AND bz IS NOT NULL AND speed IS NOT NULL)
 SELECT t::BIGINT AS time, round(bz, 6) AS bz, round(speed, 6) AS wind_bz, count(*) OVER () >= 60 AS enough FROM f WHERE j = 1""",
    "galaxy_table": f"WITH {_SAMPLE} SELECT * FROM sl",
    "galaxy_doubles": f"WITH {_SAMPLE} SELECT galaxy, 2::BIGINT AS n FROM sl WHERE galaxy LIKE 'G1%'",
    "curve_table": f"WITH {_MODELS} SELECT galaxy, count(*) AS n, round(min(radius), 6) AS least, round(sum(vo), 6) AS total FROM ml GROUP BY 1",
    "observation_selection": f"""WITH {_SAMPLE}, {_MODELS}, p AS (SELECT *, vg * abs(vg) + 0.5 * vd * abs(vd) + 0.7 * vb * abs(vb) AS bar FROM ml JOIN sl USING (galaxy) WHERE {_CUTS})
 SELECT galaxy, count(*) AS n, round(sum(bar), 4) AS v_bar2, round(sum(vo * vo - bar), 4) AS delta_v2, round(max(abs(vo - sqrt(greatest(bar, 0))) / ve), 6) AS closure_cost FROM p GROUP BY 1""",
    "curve_propagation": f"""WITH RECURSIVE {_SAMPLE}, {_MODELS}, p AS MATERIALIZED (SELECT row_number() OVER () AS r, *, (radius * 64)::BIGINT AS point FROM ml JOIN sl USING (galaxy) WHERE {_CUTS}),
 g AS MATERIALIZED (SELECT DISTINCT galaxy, ('0x' || substr(md5(galaxy), 1, 8))::UBIGINT AS k, distance_error / distance AS ds, inclination AS i, inclination_error AS di FROM p),
 b AS (SELECT galaxy, what, (bound - mean) / sd AS x FROM (SELECT galaxy, unnest(['s', 's', 'i', 'i', 'd', 'd', 'b', 'b']) AS what, unnest([1.0, 1.0, i, i, {shadow.DISK[0]}, {shadow.DISK[0]}, {shadow.BULGE[0]}, {shadow.BULGE[0]}]::DOUBLE[]) AS mean, unnest([ds, ds, di, di, {shadow.DISK[1]}, {shadow.DISK[1]}, {shadow.BULGE[1]}, {shadow.BULGE[1]}]::DOUBLE[]) AS sd,
  unnest([{", ".join(map(str, (*shadow.SCALE_BOUNDS, *shadow.INCLINATION_BOUNDS, *shadow.DISK[2:], *shadow.BULGE[2:])))}]::DOUBLE[]) AS bound FROM g)),
 t AS (SELECT galaxy, what, x, least(abs(x), 8.0) AS y, 0 AS j, least(abs(x), 8.0) AS term, least(abs(x), 8.0) AS total FROM b UNION ALL SELECT galaxy, what, x, y, j + 1, term * y * y / (2 * j + 3), total + term * y * y / (2 * j + 3) FROM t WHERE j < 150),
 c AS (SELECT galaxy, what, min(s) AS low, max(s) AS high FROM (SELECT galaxy, what, 0.5 + sign(x) * exp(-y * y / 2) / sqrt(2 * pi()) * total AS s FROM t WHERE j = 150) GROUP BY 1, 2),
 o AS (SELECT galaxy, max(low) FILTER (what = 's') AS ls, max(high) FILTER (what = 's') AS hs, max(low) FILTER (what = 'i') AS li, max(high) FILTER (what = 'i') AS hi, max(low) FILTER (what = 'd') AS ld, max(high) FILTER (what = 'd') AS hd, max(low) FILTER (what = 'b') AS lb, max(high) FILTER (what = 'b') AS hb FROM c GROUP BY 1),
 w AS (SELECT galaxy, unnest(range(0, 4096)) AS d, k FROM g),
 f AS ({_philox("w", "galaxy, d", "d::UBIGINT", "0::UBIGINT", "0::UBIGINT", "0::UBIGINT")}), h AS ({_philox("w", "galaxy, d", "d::UBIGINT", "1::UBIGINT", "0::UBIGINT", "0::UBIGINT")}),
 u AS (SELECT galaxy, d, i, ds, di, ls + {_uniform("f.a", "f.b")} * (hs - ls) AS us, li + {_uniform("f.c", "f.d0")} * (hi - li) AS ui, ld + {_uniform("h.a", "h.b")} * (hd - ld) AS ud, lb + {_uniform("h.c", "h.d0")} * (hb - lb) AS ub FROM f JOIN h USING (galaxy, d) JOIN g USING (galaxy) JOIN o USING (galaxy)),
 m AS MATERIALIZED (SELECT galaxy, d, 1 + ds * {_inverse("us")} AS scale, sin(radians(i)) / sin(radians(i + di * {_inverse("ui")})) AS tilt, {shadow.DISK[0]} + {shadow.DISK[1]} * {_inverse("ud")} AS disk, {shadow.BULGE[0]} + {shadow.BULGE[1]} * {_inverse("ub")} AS bulge FROM u),
 x AS (SELECT r, point, k, unnest(range(0, 2048)) AS j FROM p JOIN g USING (galaxy)),
 y AS (SELECT r, j, sqrt(-2 * ln({_uniform("a", "b")})) AS size, 2 * pi() * {_uniform("c", "d0")} AS angle FROM ({_philox("x", "r, j", "j::UBIGINT", "2::UBIGINT", "point::UBIGINT & 4294967295", "point::UBIGINT >> 32")})),
 z AS (SELECT r, 2 * j AS d, size * cos(angle) AS z FROM y UNION ALL SELECT r, 2 * j + 1, size * sin(angle) FROM y),
 v AS (SELECT galaxy, r, ((vo + ve * z) * tilt) ** 2 - scale * (vg * abs(vg) + disk * vd * abs(vd) + bulge * vb * abs(vb)) AS v FROM z JOIN p USING (r) JOIN m USING (galaxy, d)),
 q AS (SELECT galaxy, r, quantile_cont(v, [0.025, 0.16, 0.5, 0.84, 0.975]) AS q FROM v GROUP BY 1, 2)
 SELECT galaxy, count(*) AS n, round(sum(q[1]), 2) AS q025, round(sum(q[2]), 2) AS q16, round(sum(q[3]), 2) AS q50, round(sum(q[4]), 2) AS q84, round(sum(q[5]), 2) AS q975 FROM q GROUP BY 1""",
    "clock_feed": "SELECT 'GPS' || (c_custkey % 32 + 40) AS node, count(*) AS n, sum(c_custkey * 30)::DOUBLE AS seconds, sum(c_custkey / 8.0::DOUBLE) AS bias, sum(c_custkey / 16.0::DOUBLE) AS sigma FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 10 <> 0 AND c_custkey % 7 <> 0 GROUP BY 1",
    "position_feed": "SELECT 'GPS' || (c_custkey % 32 + 40) AS node, count(*) AS n, sum(c_custkey / 2.0::DOUBLE) AS x_km, -sum(c_custkey)::DOUBLE AS y_km, sum(c_custkey * 3)::DOUBLE AS z_km FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 9 <> 0 GROUP BY 1",
    "commented_csv": """WITH r AS (SELECT p_partkey AS k, p_partkey / 2.0::DOUBLE AS a, CASE WHEN p_partkey % 3 > 0 THEN p_partkey END::DOUBLE AS b, CASE WHEN p_partkey % 5 > 0 THEN 7 END::DOUBLE AS c FROM part WHERE p_partkey % 11 <> 0 AND p_partkey <> 1)
 SELECT k % 5 <> 0 AND k % 4 <> 0 AS width_ok, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM r GROUP BY 1""",
    "named_tokens": "SELECT s_suppkey::DOUBLE AS key, s_suppkey / 4.0::DOUBLE AS quarter, (s_suppkey % 6)::DOUBLE AS rest FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 8 <> 0",
    "profile_gate": "SELECT 'falling' AS profile, count(*) AS n, 0::BIGINT AS bad, 0::BIGINT AS rises, count(*) = 25 AS passes FROM nation UNION ALL SELECT 'broken', count(*), 1, 1, false FROM nation",
    "header_cards": """SELECT s_suppkey::VARCHAR AS path, unnest([0, 1, 2])::INTEGER AS place, unnest(['SIMPLE', 'NAXIS', 'OBJECT']) AS keyword, unnest(['T', s_suppkey::VARCHAR, s_name]) AS value FROM supplier""",
    "array_files": "WITH v AS (SELECT unnest(range(0, len(embedding))) AS i, embedding FROM embeddings) SELECT i, count(*) AS n, round(sum(embedding[i + 1]::DOUBLE), 5) AS total FROM v GROUP BY i",
    "archives": "WITH s AS (SELECT s_suppkey AS k, unnest(range(0, s_suppkey % 3 + 1)) AS i FROM supplier) SELECT k::VARCHAR AS path, 'part' || i || '/' || k || '.txt' AS member, (k + i)::BIGINT AS byte_count FROM s WHERE k + i > 0",
    "controlled_columns": "SELECT o_orderkey AS place, o_custkey AS row_id, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey",
    "fringe_fit": f"""WITH {_E}, h AS (SELECT event_type, hour, avg(value) AS v FROM e GROUP BY 1, 2), b AS (SELECT event_type, v, (hour - 473300) / 400.0::DOUBLE AS u, 2 * pi() * (hour % 24) / 24.0::DOUBLE AS p FROM h),
 r0 AS (SELECT event_type, true AS is_row, v, 1.0::DOUBLE AS t0, u AS t1, cos(p) AS t2, sin(p) AS t3, u * cos(p) AS t4, u * sin(p) AS t5 FROM b
        UNION ALL SELECT DISTINCT event_type, false, 0, 0, 0, -sin(1.0::DOUBLE), cos(1.0::DOUBLE), -0.25::DOUBLE * sin(1.0::DOUBLE), 0.25::DOUBLE * cos(1.0::DOUBLE) FROM b),
 {_ORTHOGONAL} SELECT event_type, count(*) FILTER (is_row) AS n, round(sum(v * v) FILTER (is_row), 3) AS rss, round(-sum(v) FILTER (NOT is_row), 5) AS slope FROM r6 GROUP BY 1""",
    "unix_times": "SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS t, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events",
    "phase_proxy": """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 17 - 8.0::DOUBLE AS c1, o_orderkey % 5 - 2.0::DOUBLE AS r1, o_orderkey % 3 + 1.0::DOUBLE AS s1, o_orderkey % 11 - 5.0::DOUBLE AS c2, o_orderkey % 7 - 3.0::DOUBLE AS r2 FROM orders),
 i AS (SELECT *, (c1 / s1) ** 2 + (c2 / 2) ** 2 AS i, c1 * r1 / s1 ** 2 + c2 * r2 / 4 AS x FROM o), q AS (SELECT o_orderstatus, quantile_cont(i, 0.1) AS q FROM i GROUP BY 1)
 SELECT o_orderkey, round(CASE WHEN i > 0 THEN x / i END, 9) + 0.0 AS phase, round(i, 9) AS information FROM i JOIN q USING (o_orderstatus) WHERE i >= q""",
    "quadrature_signals": f"""WITH {_E}, z AS (SELECT event_type, value, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE -0.5 END::DOUBLE AS g, 2 * pi() * 0.05 * (t / 3600 - min(t / 3600) OVER (PARTITION BY event_type)) AS a FROM e)
 SELECT event_type, round(sum(g * cos(a) * value), 4) AS c, round(sum(g * sin(a) * value), 4) AS s FROM z GROUP BY 1""",
}
