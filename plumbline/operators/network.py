"""Plane-wave search over a network of nodes: segments, delays, scores on a regular grid, the best hit, injections."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import nulls, points
from plumbline.session import saved


def segments(days: DataFrame, starts: list[str], durations: list[float]) -> DataFrame:
    """day, block, part, label, start and stop (Unix seconds, stop excluded) for each day: at each "HH:MM" a run of parts of
    the given lengths, one after the other. Both lists are parameters."""
    minute = [int(s.split(":")[0]) * 60 + int(s.split(":")[1]) for s in starts]
    ends = np.cumsum([0.0, *durations]).tolist()
    block = days.select("day", F.posexplode(F.array(*map(F.lit, minute))).alias("b", "m"))
    part = block.select("day", "b", "m", F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in zip(ends, ends[1:])])).alias("p", "r"))
    base = F.unix_date(F.col("day")) * 86400.0 + F.col("m") * 60
    label = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("-b"), F.col("b") + 1, F.lit("-p"), F.col("p") + 1)
    return part.select("day", (F.col("b") + 1).alias("block"), (F.col("p") + 1).alias("part"), label.alias("label"), (base + F.col("r.a")).alias("start"), (base + F.col("r.z")).alias("stop"))


def guarded(df: DataFrame, t: str, start: float, stop: float, guard: float = 0.0) -> DataFrame:
    """Rows of [start + guard, stop - guard): a half-open slice."""
    return df.where((F.col(t) >= start + guard) & (F.col(t) < stop - guard))


def _radical_inverse(n: Column, base: int) -> Column:
    """The digits of n in a base, mirrored behind the point."""
    places = F.sequence(F.lit(0), F.lit(int(63 / np.log2(base)) - 1))
    digit = lambda d: F.pmod(F.floor(n / F.pow(F.lit(float(base)), d)), F.lit(base)) / F.pow(F.lit(float(base)), d + 1)
    return F.aggregate(places, F.lit(0.0), lambda a, d: a + digit(d))


def velocity_bank(spark: SparkSession, templates: int, slowest: float, fastest: float) -> DataFrame:
    """template, x, y, z: velocities of all directions alike, even in the logarithm of the speed, from Halton's points in bases
    2, 3 and 5 (the first left out): the same bank each time, and a prefix of any longer one."""
    if not 0 < slowest <= fastest:
        raise ValueError("speeds must be positive and in order")
    u = spark.range(templates).select(F.col("id").alias("template"), *[_radical_inverse(F.col("id") + 1, b).alias(n) for b, n in ((2, "a"), (3, "b"), (5, "c"))])
    span = float(np.log(fastest) - np.log(slowest))
    v = u.select("template", F.exp(F.lit(float(np.log(slowest))) + F.col("a") * span).alias("speed"), (2 * F.col("b") - 1).alias("up"), (2 * np.pi * F.col("c")).alias("turn"))
    flat = F.col("speed") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("up") * F.col("up")))
    return v.select("template", (flat * F.cos("turn")).alias("x"), (flat * F.sin("turn")).alias("y"), (F.col("speed") * F.col("up")).alias("z"))


def sobol_bank(spark: SparkSession, templates: int, slowest: float, fastest: float, seed: int) -> DataFrame:
    """template, x, y, z: as velocity_bank(), from scrambled Sobol points: a seed gives one bank, whatever the partitions; a prefix of any longer
    one."""
    if not 0 < slowest <= fastest:
        raise ValueError("speeds must be positive and in order")
    low, span = float(np.log(slowest)), float(np.log(fastest) - np.log(slowest))
    u = points.sobol(spark.range(templates).withColumnRenamed("id", "template"), "template", ["__a", "__b", "__c"], seed)
    v = u.select("template", F.exp(low + F.col("__a") * span).alias("speed"), (2 * F.col("__b") - 1).alias("up"), (2 * np.pi * F.col("__c")).alias("turn"))
    flat = F.col("speed") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("up") * F.col("up")))
    return v.select("template", (flat * F.cos("turn")).alias("x"), (flat * F.sin("turn")).alias("y"), (F.col("speed") * F.col("up")).alias("z"))


def delay_spans(positions: DataFrame, bank: DataFrame) -> DataFrame:
    """template, nodes, first, last, spread: over all nodes, the least and greatest delay of a plane wave of each velocity against the mean place, and
    the root of the mean square: what guard a search needs. positions: x, y, z (a row with a null is no node); bank: template, x, y, z, a parameter
    of the search, which goes to all tasks as one row. Each task sends one row a template. No nodes, no rows."""
    nodes = positions.select("x", "y", "z").na.drop()
    centre = nodes.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    waves = bank.agg(F.array_sort(F.collect_list(F.struct("template", "x", "y", "z"))).alias("waves"))
    each = nodes.crossJoin(F.broadcast(centre.crossJoin(waves)))  # one row
    each = each.select(*[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"], F.explode("waves").alias("v"))
    delay = sum(F.col(c) * F.col(f"v.{c}") for c in "xyz") / sum(F.col(f"v.{c}") * F.col(f"v.{c}") for c in "xyz")
    out = each.select(F.col("v.template").alias("template"), delay.alias("d")).groupBy("template")
    return out.agg(F.count("*").alias("nodes"), F.min("d").alias("first"), F.max("d").alias("last"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("spread"))


def delays(positions: DataFrame, velocities: list[tuple[float, float, float]]) -> DataFrame:
    """node, template, delay: when a plane wave of each velocity (a parameter, templates count from 0) passes each node,
    against the mean place of all nodes. positions: node, x, y, z."""
    centre = positions.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    bank = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xyz", vector)]) for vector in velocities])
    each = positions.crossJoin(F.broadcast(centre)).select("node", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"], F.posexplode(bank).alias("template", "v"))
    dot = sum(F.col(c) * F.col(f"v.{c}") for c in "xyz")
    return each.select("node", "template", (dot / sum(F.col(f"v.{c}") * F.col(f"v.{c}") for c in "xyz")).alias("delay"))


def surface(values: DataFrame, delay: DataFrame, weights: DataFrame, cadence: float = 1.0) -> DataFrame:
    """template, centre, score: the weighted sum of all nodes' values at the centre plus their delays, on the line between
    the grid places beside it; only where every node of `weights` has both. values: node, k (whole grid index), z;
    weights: node, w.

    A value is sent to the two centres that it counts for, so that the lookup is one equi-join on the node and one sum
    that combines before the shuffle."""
    at = F.col("delay") / cadence
    low = F.floor(at).cast("long")
    moves = delay.join(weights, "node").select("node", "template", F.explode(F.array(F.struct((-low).alias("s"), (F.col("w") * (1 - (at - low))).alias("c")), F.struct((-low - 1).alias("s"), (F.col("w") * (at - low)).alias("c")))).alias("m"))
    nodes = weights.agg((F.count("*") * 2).alias("need"))
    sums = values.where("z IS NOT NULL").join(moves, "node").groupBy("template", (F.col("k") + F.col("m.s")).alias("centre")).agg(F.sum(F.col("z") * F.col("m.c")).alias("score"), F.count("*").alias("n"))
    return sums.crossJoin(F.broadcast(nodes)).where("n = need").select("template", "centre", "score")


def best_hit(scores: DataFrame, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """The greatest absolute score (ties: the first centre, then the first template) over all rows or for each key; no scores, no row."""
    size = F.abs(F.col("score") if digits is None else F.round("score", digits))
    best = scores.groupBy(*by).agg(F.min(F.struct((-size).alias("s"), "centre", "template", "score")).alias("b"))
    return best.where("b IS NOT NULL").select(*by, (-F.col("b.s")).alias("statistic"), "b.centre", *([] if "template" in by else ["b.template"]), "b.score")


def inject(values: DataFrame, delay: DataFrame, template: int, centre: float, amplitude: float, cadence: float = 1.0) -> DataFrame:
    """values with an impulse at each node's nearest grid place (a tie: the earlier) to its arrival; places off the grid get
    none. centre is a grid index."""
    arrival = centre + F.col("delay") / cadence
    hits = delay.where(F.col("template") == template).select("node", F.ceil(arrival - 0.5).cast("long").alias("k"), F.lit(float(amplitude)).alias("__a"))
    return values.join(hits, ["node", "k"], "left").withColumn("z", F.col("z") + F.coalesce("__a", F.lit(0.0))).select(*values.columns)


def injected_hits(values: DataFrame, delay: DataFrame, weights: DataFrame, trials: DataFrame, cadence: float = 1.0, segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """trial, statistic, centre, template of the best hit when each trial's impulses are added to the values. trials: trial, node,
    arrival (grid index), amplitude; see inject(). segment: the segment of a centre; trials then have a column segment, the same on all rows of a
    trial, and only its centres are searched; the surface is then written when this is called.

    A score is linear in the values: the surface is made once, and a trial changes only the centres that its impulses count
    for. What it leaves alone cannot win but by the greatest cells of the surface, as many as a trial can change
    and one more; those are held against every trial."""
    base = surface(values, delay, weights, cadence)
    hits = trials.select("trial", "node", F.ceil(F.col("arrival") - 0.5).cast("long").alias("k"), F.col("amplitude").cast("double").alias("a"))
    struck = values.select("node", "k").join(hits, ["node", "k"]).select("trial", "node", "k", "a")
    at = F.col("delay") / cadence
    low = F.floor(at).cast("long")
    moves = delay.join(weights, "node").select("node", "template", F.explode(F.array(F.struct((-low).alias("s"), (F.col("w") * (1 - (at - low))).alias("c")), F.struct((-low - 1).alias("s"), (F.col("w") * (at - low)).alias("c")))).alias("m"))
    added = struck.join(moves, "node").groupBy("trial", "template", (F.col("k") + F.col("m.s")).alias("centre")).agg(F.sum(F.col("a") * F.col("m.c")).alias("add"))
    if segment is not None:
        base, added = saved(base, "surface"), saved(added, "added")  # both of what follows read them
    changed = base.join(added, ["template", "centre"]).select("trial", "template", "centre", (F.col("score") + F.col("add")).alias("score"))
    if segment is not None:
        own = trials.select("trial", "segment").distinct()
        changed = changed.join(own, "trial").where(segment(F.col("centre")) == F.col("segment")).drop("segment")
    most = 2 * moves.select("node", "template").distinct().count() + 1  # nodes by templates, parameters of the search
    order = [F.desc(F.abs("score")), "centre", "template"]
    if segment is None:
        top = base.orderBy(*order).limit(most).crossJoin(trials.select("trial").distinct())
    else:
        ranked = base.withColumn("segment", segment(F.col("centre")))
        top = ranked.withColumn("__r", F.row_number().over(Window.partitionBy("segment").orderBy(*order))).where(F.col("__r") <= most).join(own, "segment").drop("segment", "__r")
    left = top.join(added.select("trial", "template", "centre"), ["trial", "template", "centre"], "left_anti")
    return best_hit(changed.unionByName(left.select("trial", "template", "centre", "score")), ("trial",))


def power(hits: DataFrame, trials: DataFrame, background: DataFrame, alpha: float, tolerance: float, share: float = 0.8) -> DataFrame:
    """amplitude, trials, detected, localised, joint, rate, lower and gate: how many trials of each amplitude have a rank p of at most alpha against the
    statistics of the background, how many a centre within the tolerance of the planted one, how many both, Wilson's lower 95 % end of
    that share, and whether it reaches `share` for the greatest amplitude (on all rows).

    hits: trial, statistic, centre (see injected_hits()); trials: trial, amplitude, centre, a row each; background: statistic. A trial
    without a hit is neither detected nor localised; without background nothing is detected."""
    one = F.lit(0).alias("family")
    ranked = nulls.rank_pvalue(hits.select("trial", "statistic", F.col("centre").alias("found"), one), background.select("statistic", one))
    each = trials.select("trial", "amplitude", "centre").join(ranked, "trial", "left")
    detected = F.coalesce(F.col("p") <= alpha, F.lit(False))
    localised = F.coalesce(F.abs(F.col("found") - F.col("centre")) <= tolerance, F.lit(False))
    n = each.groupBy("amplitude").agg(F.count("*").alias("trials"), F.count_if(detected).alias("detected"), F.count_if(localised).alias("localised"), F.count_if(detected & localised).alias("joint"))
    out = n.withColumn("rate", F.col("joint") / F.col("trials")).withColumn("lower", scalars.wilson_lower(F.col("joint"), F.col("trials")))
    gate = out.agg((F.max_by("lower", "amplitude") >= share).alias("gate"))
    return out.crossJoin(F.broadcast(gate))  # one row


def covariance_weights(covariance: np.ndarray) -> np.ndarray:
    """C^-1 1 / sqrt(1' C^-1 1), for the few nodes of a network (see ledoit_wolf)."""
    solved = np.linalg.solve(covariance, np.ones(len(covariance)))
    square = float(solved.sum())
    if not np.isfinite(square) or square <= 0:
        raise ValueError("invalid covariance")
    return solved / np.sqrt(square)
