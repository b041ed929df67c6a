"""Operators on ordered rows: splits, gaps, duplicates, extremes, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import pieces, selection
from plumbline.session import saved


def chronological_split(df: DataFrame, by: list[str], order: list[str], width: float | None = None, share: float = 0.4) -> DataFrame:
    """df with subset: of each group the first floor(share * n) rows in order are development, the rest holdout. Ranges of
    order[0] are ordered apart (see pieces.ranged)."""
    out = pieces.numbered(df, by, order, width)
    return out.withColumn("subset", F.when(F.col("i") <= F.floor(F.col("n") * share), "development").otherwise("holdout")).drop("i", "n")


def first_difference(df: DataFrame, by: list[str], order: list[str], v: str, width: float | None = None) -> DataFrame:
    """df with difference: v less the row before of its group, however far that lies; null for the first."""
    return pieces.neighbours(df, by, order, v, width).withColumn("difference", F.col(v) - F.col("before.v")).drop("before", "after")


def gap_aware_difference(df: DataFrame, node: str, t: str, v: str, cadence: float) -> DataFrame:
    """node, t, difference: v minus the node's value one epoch before, where the epoch before (of any node) is exactly
    one cadence earlier and the node has a value there; else null."""
    epochs = df.select(t).distinct()
    # the epoch before exists or not: an equi-join, no global order
    before = epochs.select((F.col(t) + cadence).alias(t), F.lit(True).alias("__has"))
    prev = df.select(node, (F.col(t) + cadence).alias(t), F.col(v).alias("__p"))
    out = df.join(before, t, "left").join(prev, [node, t], "left")
    return out.select(node, t, F.when(F.col("__has"), F.col(v) - F.col("__p")).alias("difference"))


def keep_one(df: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in order."""
    cols = [F.desc(c) if last else F.asc(c) for c in order]
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(*cols))).where("__i = 1").drop("__i")


def local_maxima(df: DataFrame, by: list[str], order: str, v: str, width: float | None = None) -> DataFrame:
    """Rows not below their left and above their right neighbour; ends of a group are none."""
    beside = pieces.neighbours(df, by, [order], v, width)
    return beside.where((F.col(v) >= F.col("before.v")) & (F.col(v) > F.col("after.v"))).drop("before", "after")


def cadence(df: DataFrame, by: str, order: list[str], width: float | None = None) -> DataFrame:
    """by, median_interval, nyquist: of the positive steps of order[0] from row to row, and half its inverse. Groups without a
    positive step give no row. The steps are written once when this is called, as their medians read them several times."""
    steps = saved(first_difference(df, [by], order, order[0], width).where("difference > 0").select(by, "difference"), "steps")
    out = selection.medians(steps, [by], "difference", "median_interval")
    return out.withColumn("nyquist", 0.5 / F.col("median_interval"))


def frequency_grid(cadences: DataFrame, ends: DataFrame, floor: float, ceiling: float, safety: float = 0.9, oversampling: int = 1) -> DataFrame:
    """k and frequency: whole multiples of the resolution 1 / (stop - start) / oversampling from `floor` up to the lower of the
    ceiling and `safety` of the least Nyquist frequency. cadences: nyquist; ends: start, stop; one row each side."""
    least = cadences.agg(F.min("nyquist").alias("nyquist"))
    span = ends.agg((F.max("stop") - F.min("start")).alias("span"))
    one = least.crossJoin(F.broadcast(span)).where("span > 0").withColumn("step", 1 / F.col("span") / oversampling)  # one row
    top = F.least(F.lit(float(ceiling)), safety * F.col("nyquist"))
    first, last = F.ceil(floor / F.col("step")).cast("long"), F.floor(top / F.col("step")).cast("long")
    return one.where(last >= first).select("step", F.explode(F.sequence(first, last)).alias("k")).select("k", (F.col("k") * F.col("step")).alias("frequency"))


def exact_mode(df: DataFrame, by: str, v: str, gate: float = 0.5) -> DataFrame:
    """by, mode (ties to the smallest), share of non-null values, and whether share reaches the gate."""
    counts = df.where(F.col(v).isNotNull()).groupBy(by, v).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(v).alias("v"))).alias("b"), F.sum("n").alias("total"))
    share = -F.col("b.m") / F.col("total")
    return best.select(by, F.col("b.v").alias("mode"), F.round(share, 9).alias("share"), (share >= gate).alias("passes"))


#: Candidates of a cell that a pass of separated_top() looks at.
KEPT = 32


def separated_top(df: DataFrame, by: str, x: str, stat: str, apart: float, k: int, probes: list[float] | None = None, probe_width: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """Greedy choice in each group: the greatest stat first (ties to the smaller x), then the next at least `apart` (less the
    tolerance) away from all chosen, up to k. Candidates nearer than probe_width to one of the probes (known places, a
    parameter) are none, and rows without an x or a stat (null or NaN) are none.

    No task gets all candidates of a group. x is cut into cells a trifle narrower than the distance d, so that a cell holds one
    choice at most and a choice shuts out candidates of its own cell and of two on either side. While j of k are chosen, 5j cells
    at most are touched, so of the best 5k - 4 cells (by their best candidate) one is untouched, and its best candidate can be chosen: all k
    choices stand in these cells. Of each the KEPT best candidates are taken to one small array a group. A choice made there is the whole
    group's as long as no cell has used up its kept ones without a choice in it; there the fold stops, what it has chosen is kept, and a further pass
    begins without all that is shut out. A pass chooses one at least, as the best candidate left is always kept."""
    d = apart - tolerance
    rows = df.select(by, F.col(x).cast("double").alias("__x"), F.col(stat).cast("double").alias("__s")).where("NOT isnan(__x) AND NOT isnan(__s)").na.drop(subset=["__x", "__s"])
    for p in probes or []:
        rows = rows.where(F.abs(F.col("__x") - p) >= probe_width)
    if d <= 0:  # nothing is shut out
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("__s"), "__x"))
        return rows.withColumn("place", place).where(F.col("place") <= k).select(by, "place", F.col("__x").alias(x), F.col("__s").alias(stat))
    cells = rows.withColumn("__c", F.floor(F.col("__x") / (d * (1 - 1e-6))))
    kind = "array<struct<s:double,x:double,c:bigint>>"
    none = F.array().cast(kind)
    chosen = None
    for _ in range(k):
        if chosen is None:
            left = cells.withColumn("__had", none)
        else:
            far = F.forall("__had", lambda y: F.abs(y["x"] - F.col("__x")) >= d)
            left = pieces.join_alike(cells, chosen.where("stopped").select(by, F.col("picked").alias("__had")), [by]).where("__had IS NOT NULL").where(far)
        best = left.groupBy(by, "__c").agg(F.min(F.struct((-F.col("__s")).alias("s"), F.col("__x").alias("x"))).alias("__top"))
        ranked = best.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy("__top"))).where(F.col("__rank") <= 5 * k - 4).select(by, "__c")
        inner = F.row_number().over(Window.partitionBy(by, "__c").orderBy(F.desc("__s"), "__x"))
        kept = pieces.join_alike(left, ranked.withColumn("__in", F.lit(True)), [by, "__c"]).where("__in").withColumn("__i", inner).where(F.col("__i") <= KEPT)
        item = F.struct((-F.col("__s")).alias("s"), F.col("__x").alias("x"), F.col("__c").alias("c"), (F.col("__i") == KEPT).alias("end"))
        groups = kept.groupBy(by, "__had").agg(F.sort_array(F.collect_list(item)).alias("__items"))

        def step(state, e):
            here = F.struct((-e["s"]).alias("s"), e["x"].alias("x"), e["c"].alias("c"))
            fits = ~state["stopped"] & (F.size(state["picked"]) < k) & F.forall(state["picked"], lambda y: F.abs(y["x"] - e["x"]) >= d)
            picked = F.when(fits, F.concat(state["picked"], F.array(here))).otherwise(state["picked"])
            used_up = e["end"] & ~F.exists(state["picked"], lambda y: y["c"] == e["c"]) & ~fits
            return F.struct(picked.alias("picked"), (state["stopped"] | (used_up & (F.size(state["picked"]) < k))).alias("stopped"))

        fold = F.aggregate("__items", F.struct(F.col("__had").alias("picked"), F.lit(False).alias("stopped")), step)
        new = groups.select(by, fold.alias("f")).select(by, "f.picked", "f.stopped")
        if chosen is not None:
            # a group whose candidates were all shut out has no row here: what it had is its result
            before = chosen.where("stopped").select(by, F.col("picked").alias("__had"))
            again = pieces.join_alike(before, new, [by]).select(by, F.coalesce("picked", "__had").alias("picked"), F.coalesce("stopped", F.lit(False)).alias("stopped"))
            new = chosen.where("NOT stopped").unionByName(again)
        chosen = saved(new, "separated")
        if chosen.where("stopped").isEmpty():
            break
    return chosen.select(by, F.posexplode("picked").alias("i", "p")).select(by, (F.col("i") + 1).alias("place"), F.col("p.x").alias(x), F.col("p.s").alias(stat))


def reversals(df: DataFrame, by: str, row: str, t: str, width: float | None = None) -> DataFrame:
    """How often t fails to grow from row to row, in ingest order (row: a number)."""
    step = first_difference(df, [by], [row], t, width)
    return step.groupBy(by).agg(F.count_if(F.col("difference") <= 0).alias("reversals"), F.count("*").alias("n"))


def quality_chain(df: DataFrame, rules: list[tuple[str, Column]], by: list[str], order: list[str]) -> DataFrame:
    """df with reason: DUPLICATE for all but the first row (in order) of a key, then the name of the first rule that does not
    hold or is null, else KEPT. Duplicates are told on all rows, before any rule."""
    copy = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1
    reason = F.when(F.col("__copy"), "DUPLICATE")
    for name, holds in rules:
        reason = reason.when(~F.coalesce(holds, F.lit(False)), name)
    return df.withColumn("__copy", copy).withColumn("reason", reason.otherwise("KEPT")).drop("__copy")


def attrition(judged: DataFrame, least: int = 0) -> DataFrame:
    """reason, n, enough: how many rows each reason took, and whether at least `least` rows are kept, on each row."""
    counts = judged.groupBy("reason").agg(F.count("*").alias("n"))
    kept = judged.agg((F.count_if(F.col("reason") == "KEPT") >= least).alias("enough"))
    return counts.crossJoin(F.broadcast(kept))  # one row


def structural(df: DataFrame, finite: list[str], unit: list[str], condition: str, values: list[float]) -> DataFrame:
    """Rows whose columns `finite` are numbers, whose columns `unit` lie in [0, 1], and whose condition is one of the values."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    keep = F.col(condition).isin(values)
    for c in [*finite, *unit]:
        keep = keep & number(c)
    for c in unit:
        keep = keep & F.col(c).between(0, 1)
    return df.where(keep)


def covered_nodes(cells: DataFrame, least_share: float = 0.98, least_nodes: int = 1) -> DataFrame:
    """node, observed, possible, coverage, selected and enough: nodes of all segments. cells: segment, epoch, node, v (null: not
    observed). A node needs at least one row in every segment, and values in least_share of all epochs of all segments; enough
    tells whether least_nodes are selected, on each row."""
    epochs = cells.select("segment", "epoch").distinct()
    totals = epochs.agg(F.count("*").alias("possible"), F.count_distinct("segment").alias("__segments"))
    seen = cells.groupBy("node").agg(F.count_if(F.col("v").isNotNull()).alias("observed"), F.count_distinct("segment").alias("__in"))
    out = seen.crossJoin(F.broadcast(totals)).withColumn("coverage", F.col("observed") / F.col("possible"))  # one row
    out = out.where(F.col("__in") == F.col("__segments")).withColumn("selected", F.col("coverage") >= least_share).drop("__in", "__segments")
    return out.crossJoin(F.broadcast(out.agg((F.count_if("selected") >= least_nodes).alias("enough"))))  # one row


def last_hours(df: DataFrame, t: str, hours: float) -> DataFrame:
    """Rows of the last `hours` before the latest t (in seconds), both ends included."""
    latest = df.agg(F.max(t).alias("__latest"))
    return df.crossJoin(F.broadcast(latest)).where(F.col(t).between(F.col("__latest") - hours * 3600, F.col("__latest"))).drop("__latest")  # one row


def extremes_by_period(df: DataFrame, by: str, period: str, v: str) -> DataFrame:
    """by, period, statistic: the greatest v of each period."""
    return df.groupBy(by, period).agg(F.max(v).alias("statistic"))


def rank_of_last(maxima: DataFrame, by: str, period: str) -> DataFrame:
    """by, n, rank_p: the last period's statistic ranked among all before it: (1 + how many reach it) / (n + 1)."""
    last = maxima.groupBy(by).agg(F.max_by("statistic", period).alias("__s"), F.max(period).alias("__p"))
    before = maxima.join(last, by).where(F.col(period) < F.col("__p"))
    out = before.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("statistic") >= F.col("__s")).alias("__k"))
    return out.select(by, "n", ((1 + F.col("__k")) / (F.col("n") + 1)).alias("rank_p"))


def final_iteration(df: DataFrame, by: list[str], iteration: str) -> DataFrame:
    """The rows of each group's last iteration: the group's maximum comes back by a join."""
    last = df.groupBy(*by).agg(F.max(iteration).alias("__last"))
    return df.join(last, by).where(F.col(iteration) == F.col("__last")).drop("__last")


def full_width(df: DataFrame, by: str, x: str, y: str, share: float = 0.5) -> DataFrame:
    """by, peak, low, high, width: between which places y is at least `share` of the group's greatest value."""
    peak = df.groupBy(by).agg(F.max(y).alias("peak"))
    out = df.join(peak, by).where(F.col(y) >= share * F.col("peak")).groupBy(by).agg(F.first("peak").alias("peak"), F.min(x).alias("low"), F.max(x).alias("high"))
    return out.withColumn("width", F.col("high") - F.col("low"))
