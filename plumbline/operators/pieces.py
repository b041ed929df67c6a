"""Ordered work in pieces: a key's rows are cut into ranges of their first ordering number, windows run inside a range, and what
crosses a border comes from a table with one row a range. So no task has a whole key, however few keys there are.

Ranges have about the same number of rows each: a mergeable quantile sketch of each key's numbers tells where to cut, so that bursts
are split and sparse stretches joined. Equal numbers stay in one range. A fixed width can be asked for instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT = "__cut"


#: Rows that a range is to have, the most ranges of a key, and the sketch's accuracy: a cut is off by a sixteenth of a range at most.
ROWS = 1 << 20
MOST = 1024
ACCURACY = 16 * MOST


def cut(t: str, width: float) -> Column:
    """The range of a number; rows without one are in a range of their own."""
    return F.floor(F.col(t) / width).cast("long")


def join_alike(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys of which nulls are alike; the keys come once, from the left."""
    r = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return left.join(r, on, "left").drop(*[f"__k_{k}" for k in keys])


def ranged(df: DataFrame, by: list[str], t: str, width: float | None = None, rows: int | None = None) -> DataFrame:
    """df with the range of each row's t in its key, ascending with t; rows without a t are in a range of their own (null), NaN is in the last.
    A key has a range for each `rows` of its rows, MOST at most; with `width`, ranges of that width. df is computed once more for the
    sketch."""
    if width is not None:
        return df.withColumn(CUT, cut(t, width))
    x = F.col(t).cast("double")
    known = df.where(x.isNotNull() & ~F.isnan(x))
    sketch = known.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx(x, [i / MOST for i in range(MOST + 1)], ACCURACY).alias("__g"))
    parts = F.least(F.ceil(F.col("__n") / (rows or ROWS)), F.lit(MOST)).cast("int")
    cuts = F.when(parts > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))), lambda i: F.get("__g", F.floor(i * MOST / parts).cast("int")))))
    held = sketch.select(*by, cuts.alias("__cuts"))
    both = join_alike(df, held, by) if by else df.crossJoin(F.broadcast(held))  # one row
    # how many cuts are not above x, by halves
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST.bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) <= x, at + step).otherwise(at))
    return both.withColumn(CUT, F.when(x.isNotNull(), F.when(F.col("__cuts").isNull(), 0).otherwise(place)).cast("long")).drop("__cuts")


def running_total(df: DataFrame, by: list[str], order: str, k: str, out: str, then: list[str], falling: bool = False) -> DataFrame:
    """df with the sum of k over all rows of its key up to its own in the order of a number, then of the columns `then`, which tell equal ones
    apart. Ranges are summed apart; a row for each range has what went before."""
    rows = ranged(df, by, order)
    side = (lambda c: F.desc(c)) if falling else (lambda c: F.asc(c))
    totals = rows.groupBy(*by, CUT).agg(F.sum(k).alias("__c"))
    along = Window.partitionBy(*by).orderBy(side(CUT))
    before = totals.select(*by, CUT, (F.sum("__c").over(along) - F.col("__c")).alias("__before"))
    inside = Window.partitionBy(*by, CUT).orderBy(side(order), *then).rowsBetween(Window.unboundedPreceding, 0)
    both = join_alike(rows.withColumn("__inner", F.sum(k).over(inside)), before, [*by, CUT])
    return both.withColumn(out, F.col("__before") + F.col("__inner")).drop(CUT, "__inner", "__before")


def numbered(df: DataFrame, by: list[str], order: list[str], width: float | None = None) -> DataFrame:
    """df with i (the row's place in its key, from 1) and n (how many rows the key has). order[0] is a number, cut into
    ranges (see ranged()); the columns of order tell all rows of a key apart."""
    rows = ranged(df, by, order[0], width)
    counts = rows.groupBy(*by, CUT).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*by).orderBy(CUT)) - F.col("__c")
    starts = counts.withColumn("__before", before).withColumn("n", F.sum("__c").over(Window.partitionBy(*by))).drop("__c")
    inner = F.row_number().over(Window.partitionBy(*by, CUT).orderBy(*order))
    out = join_alike(rows.withColumn("__i", inner), starts, [*by, CUT])
    return out.withColumn("i", F.col("__before") + F.col("__i")).drop(CUT, "__i", "__before")


def neighbours(df: DataFrame, by: list[str], order: list[str], v: str, width: float | None = None) -> DataFrame:
    """df with before and after: structs (v) of the rows beside it in its key, null at the ends. See numbered() for order."""
    held = F.struct(F.col(v).alias("v"))
    rows = ranged(df, by, order[0], width)
    w = Window.partitionBy(*by, CUT).orderBy(*order)
    place = F.struct(*order)
    edges = rows.groupBy(*by, CUT).agg(F.min_by(held, place).alias("__first"), F.max_by(held, place).alias("__last"))
    along = Window.partitionBy(*by).orderBy(CUT)
    edges = edges.select(*by, CUT, F.lag("__last").over(along).alias("__left"), F.lead("__first").over(along).alias("__right"))
    inner = rows.withColumn("__b", F.lag(held).over(w)).withColumn("__a", F.lead(held).over(w))
    out = join_alike(inner, edges, [*by, CUT])
    return out.withColumn("before", F.coalesce("__b", "__left")).withColumn("after", F.coalesce("__a", "__right")).drop(CUT, "__b", "__a", "__left", "__right")


def around(df: DataFrame, by: list[str], t: str, point: str, width: float | None = None, order: str | None = None) -> DataFrame:
    """df with lo and hi: the last point that is not null at t or before, and the first at t or after, in the row's key. Rows with
    a point come first of equal t. Of points at one t, lo is the last and hi the first in `order` (a column; none: points of one
    key stand at different t)."""
    rows = ranged(df, by, t, width)
    there = F.col(point).isNotNull()
    tie = [order] if order else []
    place = F.struct(t, *tie)
    edges = rows.where(there).groupBy(*by, CUT).agg(F.min_by(point, place).alias("__first"), F.max_by(point, place).alias("__last"))
    # every range has a row, also those without points
    edges = join_alike(rows.select(*by, CUT).distinct(), edges, [*by, CUT])
    along, back_along = Window.partitionBy(*by).orderBy(CUT), Window.partitionBy(*by).orderBy(F.desc(CUT))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    left, right = F.last("__last", ignorenulls=True).over(before(along)), F.last("__first", ignorenulls=True).over(before(back_along))
    edges = edges.select(*by, CUT, left.alias("__left"), right.alias("__right"))
    # running last values both ways: a frame that only grows costs a step a row
    up = Window.partitionBy(*by, CUT).orderBy(F.asc(t), F.desc(there), *map(F.asc, tie)).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, CUT).orderBy(F.desc(t), F.desc(there), *map(F.desc, tie)).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("__lo", F.last(point, ignorenulls=True).over(up)).withColumn("__hi", F.last(point, ignorenulls=True).over(down))
    out = join_alike(inner, edges, [*by, CUT])
    return out.withColumn("lo", F.coalesce("__lo", "__left")).withColumn("hi", F.coalesce("__hi", "__right")).drop(CUT, "__lo", "__hi", "__left", "__right")
