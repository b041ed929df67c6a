"""Parsers of whitespace-token, comment-CSV and header texts. Each takes rows of text (spark.read.text: value) and returns
typed columns; lines that do not fit are left out, numbers that do not parse become null, NaN counts as null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import joins, ordered

#: The name of a clock product, and the widths of the token tables.
CLOCK_NAME = r"^\.Satellite\.(GPS\d+)\.Clk\.Bias$"
SAMPLE_TOKENS, MODEL_TOKENS, CLOCK_TOKENS = 19, 10, 5
#: What stands before a comment: quoted fields whole, a quote that nothing closes as any other character.
_BEFORE_COMMENT = r'^((?:[^"#]++|"[^"]*+"|"(?=[^"]*+$))*+)'


def number(c: Column) -> Column:
    """A double, or null where it does not parse or is not finite."""
    x = c.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # NaN is above all numbers


def parsed(lines: DataFrame, count: int, keep: dict[str, int], pick: dict[str, int], fits: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines of exactly `count` tokens (with `fits`: of `count` and more, whose tokens meet it) as texts (keep) and numbers (pick) by
    place; lines in which one is no number go.

    One generator makes a row of a line or none, so that a line is split once: filters and projections above it see columns,
    and are not pushed into it."""
    split = F.array(F.split(F.trim("value"), r"\s+"))
    right = (lambda t: F.size(t) == count) if fits is None else (lambda t: (F.size(t) >= count) & fits(t))
    at = lambda t, i: F.get(t, F.lit(i))
    row = lambda t: F.struct(*[at(t, i).alias(n) for n, i in keep.items()], F.transform(F.array(*[at(t, i) for i in pick.values()]), number).alias("__d"))
    rows = F.filter(F.transform(F.filter(split, right), row), lambda r: ~F.exists(r["__d"], lambda x: x.isNull()))
    return lines.select(F.inline(rows)).select(*keep, *[F.get("__d", F.lit(i)).alias(n) for i, n in enumerate(pick)])


def rotation_sample(lines: DataFrame) -> DataFrame:
    """Galaxies of a 19-token table: name, distance and inclination with errors, quality; rows that parse whole."""
    pick = {"distance": 2, "distance_error": 3, "inclination": 5, "inclination_error": 6, "quality": 17}
    return parsed(lines, SAMPLE_TOKENS, {"galaxy": 0}, pick)


def mass_models(lines: DataFrame) -> DataFrame:
    """Radii of a 10-token table: galaxy, then nine numbers."""
    names = ["distance", "radius", "v_obs", "v_err", "v_gas", "v_disk", "v_bulge", "sb_disk", "sb_bulge"]
    return parsed(lines, MODEL_TOKENS, {"galaxy": 0}, {n: i + 1 for i, n in enumerate(names)})


def clock_lines(lines: DataFrame) -> DataFrame:
    """Satellite clock biases: jpl_second, node, bias_m, sigma_m; other satellites, negative sigmas and bad numbers go."""
    t = parsed(lines, CLOCK_TOKENS, {"name": 4}, {"jpl_second": 0, "bias_m": 2, "sigma_m": 3})
    out = t.select("jpl_second", F.regexp_extract("name", CLOCK_NAME, 1).alias("node"), "bias_m", "sigma_m")
    return out.where("node <> '' AND sigma_m >= 0")


def position_lines(lines: DataFrame) -> DataFrame:
    """Satellite positions of E lines: jpl_second, node, x_km, y_km, z_km."""
    satellite = lambda t: (F.get(t, F.lit(0)) == "E") & F.get(t, F.lit(1)).startswith("GPS")
    return parsed(lines, 7, {"node": 1}, {"jpl_second": 2, "x_km": 4, "y_km": 5, "z_km": 6}, satellite).select("jpl_second", "node", "x_km", "y_km", "z_km")


def comment_csv(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a CSV whose text after any # outside double quotes is a comment, with the names of columns as numbers, and width_ok: whether the row has as
    many fields as there are columns (missing ones are null, further ones are cut). Fields in double quotes may hold commas;
    the header, a row that begins with the first name, goes."""
    bare = lines.select(F.trim(F.regexp_extract("value", _BEFORE_COMMENT, 1)).alias("v")).where("v <> ''")
    schema = ", ".join(f"f{i} string" for i in range(len(columns) + 1))
    t = bare.select(F.from_csv("v", F.lit(schema)).alias("t"))
    width = (F.col(f"t.f{len(columns) - 1}").isNotNull()) & F.col(f"t.f{len(columns)}").isNull()
    rows = t.where(F.trim("t.f0") != columns[0])
    return rows.select(*[number(F.trim(f"t.f{i}")).alias(n) for i, n in enumerate(columns)], width.alias("width_ok"))


def fits_cards(files: DataFrame) -> DataFrame:
    """path, place, keyword and value of a FITS header in rows (path, content): 80-byte cards up to END, quotes and comments
    off."""
    text = files.select("path", F.decode("content", "ISO-8859-1").alias("c"))
    cards = text.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length("c") / 80).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col("c"), i * 80 + 1, F.lit(80)))).alias("place", "card"))
    ends = cards.where("trim(card) = 'END'").groupBy("path").agg(F.min("place").alias("end"))
    value = F.regexp_replace(F.trim(F.split_part(F.substring("card", 11, 70), F.lit("/"), F.lit(1))), "^'|\\s*'$", "")
    return cards.join(ends, "path").where("place < end AND substring(card, 9, 1) = '='").select("path", "place", F.trim(F.substring("card", 1, 8)).alias("keyword"), value.alias("value"))


def header_rows(documents: DataFrame, columns: list[str], time: str | list[str]) -> DataFrame:
    """JSON arrays whose first row names the columns (rows: json): numbers by name, time as a timestamp; bad times and rows of
    other widths go, and of equal times the last stays. Of several names for the time, each document goes by the first that
    its own header has."""
    rows = documents.select(F.from_json("json", "array<array<string>>").alias("a")).select(F.col("a")[0].alias("h"), F.posexplode(F.slice(F.col("a"), 2, F.greatest(F.size("a") - 1, F.lit(1)))).alias("i", "r")).where(F.size("r") == F.size("h"))
    at = lambda n: F.try_element_at("r", F.nullif(F.array_position("h", n), F.lit(0).cast("long")).cast("int"))
    names = [time] if isinstance(time, str) else time
    stamp = F.coalesce(*[F.when(F.array_contains("h", n), F.struct(at(n).alias("at"))) for n in names])["at"]
    out = rows.select(F.try_to_timestamp(stamp).alias("time"), "i", *[number(at(c)).alias(c) for c in columns]).where("time IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("time").orderBy(F.desc("i")))
    return out.withColumn("__k", last).where("__k = 1").drop("__k", "i")


def parallel_series(documents: DataFrame) -> DataFrame:
    """JSON of parallel arrays, times and values[].id/values: time, id, value; a list of another length gives no rows."""
    doc = documents.select(F.from_json("json", "times array<string>, values array<struct<id string, values array<double>>>").alias("d"))
    each = doc.select("d.times", F.explode("d.values").alias("s")).where(F.size("times") == F.size("s.values"))
    return each.select("s.id", F.inline(F.arrays_zip("times", F.col("s.values").alias("value")))).select(F.try_to_timestamp("times").alias("time"), "id", "value").where("time IS NOT NULL")


def wide_series(rows: DataFrame, ids: list[str]) -> DataFrame:
    """time and a column of each id (a parameter): the values of parallel_series() at each time, null where an id has none; of several
    values of one id and time the greatest."""
    return rows.groupBy("time").agg(*[F.max(F.when(F.col("id") == i, F.col("value"))).alias(i) for i in ids])


def doubled_keys(df: DataFrame, key: str) -> DataFrame:
    """key and n of keys that stand more than once: a table of one row a galaxy has none."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def fill_to_null(df: DataFrame, fills: dict[str, float], huge: float | None = None) -> DataFrame:
    """Values within 1e-12 of their column's fill become null; with `huge`, so does what is that large."""
    for c, fill in fills.items():
        bad = F.abs(F.col(c) - fill) <= 1e-12
        df = df.withColumn(c, F.when(~(bad | (F.abs(F.col(c)) >= huge) if huge else bad), F.col(c)))
    return df


def hapi_rows(documents: DataFrame, names: list[str]) -> DataFrame:
    """Rows of JSON feeds {"parameters": [{"name": ...}], "data": [[...]]} (rows: json): time from the first parameter, then
    `names` as numbers, a part of a vector parameter being name_0, name_1, ...; rows of another width than the parameters
    and bad times go."""
    doc = documents.select(F.from_json("json", "parameters array<struct<name string>>, data array<array<string>>").alias("d"))
    rows = doc.select(F.transform("d.parameters", lambda p: p["name"]).alias("h"), F.explode("d.data").alias("r")).where(F.size("h") == F.size("r"))

    def cell(name: str):
        at = lambda n: F.try_element_at("r", F.nullif(F.array_position("h", n), F.lit(0).cast("long")).cast("int"))
        head, _, place = name.rpartition("_")
        whole = number(at(name))
        if not (head and place.isdigit()):
            return whole
        part = F.get(F.from_json(at(head), "array<string>"), F.lit(int(place)))
        return F.coalesce(whole, number(part))

    return rows.select(F.try_to_timestamp(F.col("r")[0]).alias("time"), *[cell(n).alias(n) for n in names]).where("time IS NOT NULL")


def merge_nearest(left: DataFrame, right: DataFrame, values: list[str], tolerance: float = 45.0, least: int = 60, row: str = "row") -> DataFrame:
    """time (seconds) and values of two feeds: each left row with the right row nearest in time, complete rows only, the first of
    equal times (in order of `row`, a number of the feed's rows), and enough: whether at least `least` rows are left, on each
    row. A value that neither feed has, or a feed without time or row, is an error."""
    there = set(left.columns)
    missing = [c for c in values if c not in there and c not in right.columns] + [c for c in ("time", row) if not (c in there and c in right.columns)]
    if missing:
        raise ValueError(f"columns that the feeds lack: {missing}")
    both = joins.asof_nearest(left, right, tolerance, "time", order=row)
    rows = both.select("time", F.col(row).alias("__row"), *[F.col(c if c in there else f"r_{c}").alias(c) for c in values]).na.drop()
    one = ordered.keep_one(rows, ["time"], ["__row"]).drop("__row")
    return one.crossJoin(F.broadcast(one.agg((F.count("*") >= least).alias("enough"))))  # one row


def named_table(lines: DataFrame, names: list[str]) -> DataFrame:
    """Lines of as many white-space tokens as names, all numbers; lines of another width or with text go, comments (#) too."""
    return parsed(lines.where("NOT startswith(ltrim(value), '#')"), len(names), {}, {n: i for i, n in enumerate(names)})


def strict_profile(df: DataFrame, x: str, sigma: str, rows: int) -> DataFrame:
    """One row on a profile: n, bad (null, not finite, or a negative sigma), rises (places where x does not fall, in order of
    row), and whether it passes: as many rows as told, none bad, none rising. Profiles have tens of rows by contract."""
    w = Window.partitionBy(F.lit(1)).orderBy("row")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    each = df.select("row", x, sigma, (F.col(x) >= F.lag(x).over(w)).alias("__up"))
    out = each.agg(F.count("*").alias("n"), F.count_if(~(finite(x) & finite(sigma) & F.coalesce(F.col(sigma) >= 0, F.lit(False)))).alias("bad"), F.count_if("__up").alias("rises"))
    return out.withColumn("passes", (F.col("n") == rows) & (F.col("bad") == 0) & (F.col("rises") == 0))
