"""Exact quantiles of groups of any size: order statistics are closed in on by passes that count, in bounded memory.

A group of few rows is one aggregation, which holds its values. Of a larger one no task holds the values: a mergeable sketch gives a
grid of the group's values in order, a pass counts the rows below, at and between the two beside the wanted rank, and the next pass looks
only between them. What the sketch says is a guess to count by; counts alone decide, so its error costs passes and never a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.pieces import join_alike
from plumbline.session import saved

#: Rows up to which a group is one aggregation, or what is left of it one sorted array.
SMALL = 1 << 17
#: Values that a sketch gives in order, and its accuracy: ranks are off by a part in so many, which is below a cell of the grid.
GRID, ACCURACY = 256, 10_000
#: Each pass leaves a hundredth of the rows or less, so that this is out of reach.
MOST_PASSES = 40


def quantiles(df: DataFrame, by: list[str], v: str | Column, shares: list[float], small: int = SMALL) -> DataFrame:
    """by, n and q: exact quantiles (an array in the order of shares) of each group's n values, on straight lines between the order
    statistics beside share * (n - 1). Nulls and NaN are no values; groups without values give no row; a null key is a group.

    Groups of up to `small` values are one aggregation. Whether there are larger ones is counted when this is called; for those
    keys and values are written once, and passes over that table run at once: none of them computes df again."""
    value = F.col(v) if isinstance(v, str) else v
    names = dict(zip([f"__k{i}" for i in range(len(by))], by))
    rows = df.select(F.lit(0).alias("__k"), *[F.col(c).alias(k) for k, c in names.items()], value.cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    by = ["__k", *names]  # names of their own, whatever the caller's are, and one key at least
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    large = counts.where(F.col("n") > small)
    plain = lambda of: of.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("__v", F.array(*map(F.lit, shares))).alias("q"))
    if large.isEmpty():
        return plain(rows).drop("__k").withColumnsRenamed(names)
    rows = saved(rows, "group-values")
    large = saved(rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > small), "large-groups")
    mark = large.drop("n").withColumn("__large", F.lit(True))
    few = join_alike(rows, mark, by).where("__large IS NULL").drop("__large")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * s), F.ceil((F.col("n") - 1) * s)) for s in shares])))
    found = order_statistics(rows, large.select(*by, F.explode(ranks).alias("rank")), by, small)
    each = large.select(*by, "n", F.posexplode(F.array(*map(F.lit, shares))).alias("s", "share")).withColumn("h", (F.col("n") - 1) * F.col("share"))
    low = join_alike(each.withColumn("rank", F.floor("h")), found.withColumnRenamed("value", "low"), [*by, "rank"])
    both = join_alike(low.withColumn("rank", F.ceil("h")), found.withColumnRenamed("value", "high"), [*by, "rank"])
    line = F.col("low") + (F.col("h") - F.floor("h")) * (F.col("high") - F.col("low"))
    ordered = both.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("s", line.alias("q")))).alias("x")).select(*by, "n", F.col("x.q").alias("q"))
    return plain(few).unionByName(ordered).drop("__k").withColumnsRenamed(names)


def order_statistics(rows: DataFrame, ranks: DataFrame, by: list[str], small: int) -> DataFrame:
    """by, rank and value: the value at each wanted rank (from 0) of the group's rows in order. rows: by, __v; ranks: by, rank, in
    reach of the group."""
    unbounded = [F.lit(None).cast("double").alias(c) for c in ("lo", "hi")]
    state = ranks.select(*by, "rank", *unbounded, F.lit(0).cast("long").alias("below"))
    found: list[DataFrame] = []
    grid = [i / GRID for i in range(GRID + 1)]
    keys = [*by, "rank"]
    for _ in range(MOST_PASSES):
        inside = _inside(rows, state, by)
        first = saved(inside.groupBy(*keys, "lo", "hi", "below").agg(F.count("*").alias("m"), F.percentile_approx("__v", grid, ACCURACY).alias("g")), "grids")
        done = first.where(F.col("m") <= small).drop("m", "g")
        at = F.col("rank") - F.col("below")
        if not done.isEmpty():
            sorted_ = _inside(rows, done, by).groupBy(*keys, "below").agg(F.sort_array(F.collect_list("__v")).alias("x"))
            found.append(saved(sorted_.select(*keys, F.get("x", at.cast("int")).alias("value")), "values"))
        left = first.where(F.col("m") > small)
        if left.isEmpty():
            break
        share = at / F.col("m") * GRID
        a = F.get("g", F.greatest(F.floor(share) - 1, F.lit(0)).cast("int"))
        b = F.get("g", F.least(F.ceil(share) + 1, F.lit(GRID)).cast("int"))
        between = left.select(*keys, "lo", "hi", "below", a.alias("a"), b.alias("b"))
        v = F.col("__v")
        counted = _inside(rows, between, by).groupBy(*keys, "lo", "hi", "below", "a", "b").agg(
            F.count_if(v < F.col("a")).alias("under"), F.count_if(v == F.col("a")).alias("at_a"),
            F.count_if((v > F.col("a")) & (v < F.col("b"))).alias("mid"), F.count_if((v == F.col("b")) & (F.col("a") < F.col("b"))).alias("at_b"),
        )
        up = [F.col("under"), F.col("under") + F.col("at_a"), F.col("under") + F.col("at_a") + F.col("mid"), F.col("under") + F.col("at_a") + F.col("mid") + F.col("at_b")]
        is_a, is_b = (at >= up[0]) & (at < up[1]), (at >= up[2]) & (at < up[3])
        low = F.when(at < up[0], F.col("lo")).when(at < up[2], F.col("a")).otherwise(F.col("b"))
        high = F.when(at < up[0], F.col("a")).when(at < up[2], F.col("b")).otherwise(F.col("hi"))
        passed = F.when(at < up[0], F.lit(0)).when(at < up[2], up[1]).otherwise(up[3])
        moved = saved(counted.select(*keys, F.when(is_a, F.col("a")).when(is_b, F.col("b")).alias("value"), low.alias("lo"), high.alias("hi"), (F.col("below") + passed).alias("below")), "brackets")
        found.append(moved.where("value IS NOT NULL").select(*keys, "value"))
        state = moved.where("value IS NULL").drop("value")
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"no order statistic after {MOST_PASSES} passes")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _inside(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside each bracket of their group that they lie in; both ends are outside, none is no bound. Brackets are a few a large group,
    of which there are at most the rows' number over `small`."""
    held = state.withColumn("__held", F.lit(True))
    return join_alike(rows, held, by).where("__held").where("(lo IS NULL OR __v > lo) AND (hi IS NULL OR __v < hi)").drop("__held")


def medians(df: DataFrame, by: list[str], v: str | Column, out: str = "median", small: int = SMALL) -> DataFrame:
    """by and the exact median of each group's values (see quantiles())."""
    return quantiles(df, by, v, [0.5], small).select(*by, F.get("q", F.lit(0)).alias(out))

