"""Nearest-time, band, bracket, validated and suffix joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import pieces


def asof_nearest(left: DataFrame, right: DataFrame, tolerance: float, t: str = "t", by: tuple[str, ...] = (), order: str | None = None, ranges: float | None = None) -> DataFrame:
    """Every left row with the right row nearest in t within the tolerance (inclusive), ties to the earlier; right
    columns get the prefix r_ and are null where nothing is near. A null t or key matches nothing.

    Of right rows of one time the last in `order` (a right column; none: all its columns) is the nearest before, the first
    the nearest after. Both sides are cut into ranges of about as many rows each (with `ranges`: of that many tolerances) and ordered
    there; a row for each range carries the right rows outside it that are nearest. No pairs are made."""
    if ranges is not None and ranges <= 0:
        raise ValueError("a range must have a width")
    names = right.columns
    fits = F.col(t).isNotNull()
    for c in by:
        fits = fits & F.col(c).isNotNull()
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    ord_ = F.col(order) if order else F.struct(*names)
    there = right.where(fits).select(*keys, F.col(t).alias("__t"), ord_.alias("__o"), F.struct(*names).alias("__r"))
    here = left.where(fits).select(*keys, F.col(t).alias("__t"), F.struct(*left.columns).alias("__l"))
    both = there.unionByName(here, allowMissingColumns=True)
    rows = pieces.around(both, [f"__k{i}" for i in range(len(by))], "__t", "__r", None if ranges is None else ranges * tolerance, "__o").where("__l IS NOT NULL")
    gap_back, gap_ahead = F.col("__t") - F.col(f"lo.{t}"), F.col(f"hi.{t}") - F.col("__t")
    near = F.when(gap_back.isNotNull() & (gap_ahead.isNull() | (gap_back <= gap_ahead)), F.col("lo")).otherwise(F.col("hi"))
    hit = F.when(F.least(gap_back, gap_ahead) <= tolerance, near)
    out = rows.withColumn("__hit", hit).select("__l.*", *[F.col(f"__hit.{n}").alias(f"r_{n}") for n in names])
    return out.unionByName(left.where(~fits), allowMissingColumns=True)


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("time",)) -> DataFrame:
    """df with a prefix to all column names but those kept."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def band_join(left: DataFrame, right: DataFrame, x: str, y: str, half_width: float) -> DataFrame:
    """Pairs with |left.x - right.y| <= half_width, by buckets of that width."""
    b = lambda c: F.floor(F.col(c) / half_width).cast("long")
    l = left.withColumn("__b", F.explode(F.array(b(x) - 1, b(x), b(x) + 1)))  # noqa: E741
    r = right.withColumn("__b", b(y))
    return l.join(r, "__b").where(F.col(y).between(F.col(x) - half_width, F.col(x) + half_width)).drop("__b")


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join whose result says, row by row, whether the right side was unique: MATCHED, UNMATCHED or AMBIGUOUS. An
    ambiguous key has several right rows; none of them is picked, so the right columns are null."""
    others = [c for c in right.columns if c != key]
    one = right.groupBy(key).agg(F.count("*").alias("__n"), F.min(F.struct(*others)).alias("__r") if others else F.lit(None).alias("__r"))
    status = F.when(F.col("__n").isNull(), "UNMATCHED").when(F.col("__n") > 1, "AMBIGUOUS").otherwise("MATCHED")
    picked = [F.when(F.col("__n") == 1, F.col(f"__r.{c}")).alias(c) for c in others]
    return left.join(one, key, "left").select(*left.columns, *picked, status.alias("join_status"))


def unmatched_keys(left: DataFrame, right: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The first `most` left keys in order that the right side lacks: what an error message names."""
    return left.join(right, key, "left_anti").select(key).distinct().orderBy(key).limit(most)


def suffix_lookup(names: DataFrame, entries: DataFrame, suffix: str = "suffix", path: str = "path") -> DataFrame:
    """names with path, n and lookup_status: the one entry whose path ends with the suffix (FOUND), or none (NOT_FOUND), or more
    (AMBIGUOUS, no path). A suffix may begin inside a file name, so an entry comes once for each ending of its own, and meets
    the suffixes whose last part that is; what stands before is then compared."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    there = entries.select(F.col(path).alias("__path")).withColumn("__base", base(F.col("__path")))
    wanted = names.withColumn("__base", base(F.col(suffix)))
    ends = F.transform(F.sequence(F.lit(1), F.length("__base")), lambda i: F.substring(F.col("__base"), -i, i))
    there = there.withColumn("__base", F.explode(ends))
    found = wanted.join(there, "__base").where(F.endswith(F.col("__path"), F.col(suffix))).groupBy(suffix).agg(F.count("*").alias("__n"), F.min("__path").alias("__p"))
    status = F.when(F.col("__n").isNull(), "NOT_FOUND").when(F.col("__n") > 1, "AMBIGUOUS").otherwise("FOUND")
    return names.join(found, suffix, "left").select(*names.columns, F.when(F.col("__n") == 1, F.col("__p")).alias("path"), F.coalesce("__n", F.lit(0)).alias("n"), status.alias("lookup_status"))


def interpolate(marks: DataFrame, series: DataFrame, t: str, v: str, by: str, width: float | None = None) -> DataFrame:
    """Linear value of each by-series at marks (by, t): null outside its coverage. Points of one series stand at different t. Ranges of t are
    ordered apart (see pieces.around)."""
    none = F.lit(None).cast(f"struct<t:double,v:{series.schema[v].dataType.simpleString()}>")
    point = F.struct(F.col(t).cast("double").alias("t"), F.col(v).alias("v"))
    both = marks.select(by, t, none.alias("__p"), F.lit(True).alias("__m")).unionByName(series.select(by, t, point.alias("__p"), F.lit(False).alias("__m")))
    out = pieces.around(both, [by], t, "__p", width).where("__m")
    at = lambda side, x: F.col(f"{side}.{x}")
    line = at("lo", "v") + (at("hi", "v") - at("lo", "v")) * (F.col(t) - at("lo", "t")) / (at("hi", "t") - at("lo", "t"))
    value: Column = F.when(at("lo", "t") == F.col(t), at("lo", "v")).when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), line)
    return out.select(by, t, value.alias("value"))
