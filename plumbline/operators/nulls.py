"""Null distributions and what follows from them: rotations, permutations, ranks, critical values, power."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import fourier, pieces


def rank_pvalue(targets: DataFrame, nulls: DataFrame, stat: str = "statistic", by: str = "family") -> DataFrame:
    """targets with p = (1 + how many nulls of the family reach the statistic) / (n + 1); null where a family has none. Nulls are
    counted by value before the shuffle, and added up from the greatest in ranges of values (see pieces.running_total), so that one family is many
    tasks, whatever the number of targets."""
    n = nulls.groupBy(by).agg(F.count("*").alias("__n"))
    counts = nulls.groupBy(by, stat).agg(F.count("*").alias("__k"), F.lit(False).alias("__t"))
    places = targets.select(by, stat).distinct().select(by, stat, F.lit(0).cast("long").alias("__k"), F.lit(True).alias("__t"))
    # nulls of the same value come first
    reached = pieces.running_total(counts.unionByName(places), [by], stat, "__k", "__hit", ["__t"], falling=True).where("__t").select(by, stat, "__hit")
    out = targets.join(n, by, "left").join(reached, [by, stat], "left")
    return out.withColumn("p", (1 + F.col("__hit")) / (F.col("__n") + 1)).drop("__n", "__hit")


def critical_value(nulls: DataFrame, alpha: float, stat: str = "statistic", by: str = "family") -> DataFrame:
    """by, n, critical: of n nulls in falling order the one at floor(alpha * (n + 1) - 1), from 0; null when that is below 0. Counted in
    ranges of values."""
    counts = nulls.groupBy(by, stat).agg(F.count("*").alias("__k"))
    n = nulls.groupBy(by).agg(F.count("*").alias("n"))
    place = F.floor(alpha * (F.col("n") + 1) - 1)
    # the first value at which more rows are counted than stand before the place
    at = pieces.running_total(counts, [by], stat, "__k", "__to", [], falling=True).join(n, by).where((place >= 0) & (F.col("__to") > place))
    return n.join(at.groupBy(by).agg(F.max(stat).alias("critical")), by, "left")


def shift_table(sizes: DataFrame, draws: int, seed: int, by: str = "group") -> DataFrame:
    """draw, by, shift: a rotation of 1 to n - 1 for each draw and group, from a hash of seed, draw and group: the same whatever
    the partitions. sizes: by, n."""
    each = sizes.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return each.where("n > 1").select("draw", by, (F.pmod(F.xxhash64(F.lit(seed), "draw", by), F.col("n") - 1) + 1).cast("long").alias("shift"))


def permutation_table(spark, blocks: int, draws: int, seed: int) -> DataFrame:
    """draw, block, source: permutations of blocks 0 to blocks - 1, in the order of a hash of seed, draw and block."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(F.xxhash64(F.lit(seed), F.col("id"), b).alias("h"), b.cast("int").alias("b"))))
    return spark.range(draws).select(F.col("id").alias("draw"), F.posexplode(order).alias("block", "o")).select("draw", "block", F.col("o.b").alias("source"))


def rotations(df: DataFrame, by: list[str], i: str, x: list[str], y: str) -> DataFrame:
    """by, shift and one total for each x: sum of x[i] * y[(i + shift) mod n] at all shifts, i being 0 to n - 1, by Fourier transforms, which long
    series take over many tasks (see fourier.transform). Keys are not null."""
    keys = {f"__k{j}": b for j, b in enumerate(by)}
    every = [*x, y]
    size = F.max(i) + 1
    rows = df.select(*[F.col(b).alias(k) for k, b in keys.items()], F.col(i).cast("long").alias("i"), F.explode(F.array(*[F.struct(F.lit(j).alias("__c"), F.col(c).cast("double").alias("re")) for j, c in enumerate(every)])).alias("__v")).select(*keys, "i", "__v.*")
    lengths = df.groupBy(*[F.col(b).alias(k) for k, b in keys.items()]).agg(size.cast("long").alias("n"))
    most = fourier.longest(lengths)
    spectra = fourier.transform(rows.join(lengths, list(keys)).withColumn("im", F.lit(0.0)), [*keys, "__c"], most=most)
    base = spectra.where(F.col("__c") == len(x)).drop("__c").withColumnsRenamed({"re": "br", "im": "bi"})
    both = spectra.where(F.col("__c") < len(x)).join(base, [*keys, "n", "i"])
    product = both.select(*keys, "__c", "n", "i", (F.col("re") * F.col("br") + F.col("im") * F.col("bi")).alias("re"), (F.col("re") * F.col("bi") - F.col("im") * F.col("br")).alias("im"))
    totals = fourier.transform(product, [*keys, "__c"], inverse=True, most=most).groupBy(*keys, "i").agg(*[F.max(F.when(F.col("__c") == j, F.col("re"))).alias(f"__t{j}") for j in range(len(x))])
    return totals.select(*[F.col(k).alias(b) for k, b in keys.items()], F.col("i").alias("shift"), *[F.col(f"__t{j}").alias(c) for j, c in enumerate(x)])


def rotation_null(signals: DataFrame, shifts: DataFrame, grams: DataFrame) -> DataFrame:
    """draw and statistic: for each draw the greatest score over all frequencies when each group's residuals are rotated by its
    shift. signals: group, frequency, i, zc, zs, r (arms of one group are summed before); shifts: draw, group, shift; grams:
    frequency, cc, cs, ss."""
    totals = rotations(signals, ["group", "frequency"], "i", ["zc", "zs"], "r")
    scores = totals.join(shifts, ["group", "shift"]).groupBy("draw", "frequency").agg(F.sum("zc").alias("c"), F.sum("zs").alias("s"))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    stat = (F.col("ss") * F.col("c") * F.col("c") - 2 * F.col("cs") * F.col("c") * F.col("s") + F.col("cc") * F.col("s") * F.col("s")) / det
    return scores.join(grams.where(det > 0), "frequency").groupBy("draw").agg(F.max(stat).alias("statistic"))


def coherence_null(blocks: DataFrame, permutations: DataFrame, least: int = 6) -> DataFrame:
    """draw and statistic: the greatest coherence over names when the second series' blocks change places. blocks: name, block,
    ar, ai, br, bi (null: not valid); a name needs `least` valid pairs."""
    first = blocks.select("name", "block", "ar", "ai").where("ar IS NOT NULL AND ai IS NOT NULL")
    second = blocks.select("name", F.col("block").alias("source"), "br", "bi").where("br IS NOT NULL AND bi IS NOT NULL")
    pairs = first.join(permutations, "block").join(second, ["name", "source"])
    sums = pairs.groupBy("draw", "name").agg(*coherence_sums(), F.count("*").alias("n")).where(F.col("n") >= least)
    return sums.groupBy("draw").agg(F.max(coherence_of()).alias("statistic"))


def coherence_sums() -> list:
    """The four sums that coherence_of() takes, over rows of ar, ai, br, bi."""
    a, b, c, d = (F.col(x) for x in ("ar", "ai", "br", "bi"))
    return [F.sum(a * c + b * d).alias("re"), F.sum(a * d - b * c).alias("im"), F.sum(a * a + b * b).alias("pa"), F.sum(c * c + d * d).alias("pb")]


def coherence_of():
    return F.when((F.col("pa") > 0) & (F.col("pb") > 0), (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("pa") * F.col("pb")))


def power_grid(spark, score: np.ndarray, cross: np.ndarray, frequencies: list[float], amplitudes: list[float], critical: float, phases: int = 16) -> DataFrame:
    """frequency, amplitude, detected, identified: shares of phases at which an injected signal passes the critical value, and at
    which its own frequency also has the greatest statistic. The score is linear in what is injected, so that no data are read:
    score (frequencies, 2) and cross (frequencies, frequencies, 2, 2) come from gram() of projected signals. A row of
    the grid is a row of Spark."""
    inverse = np.stack([np.linalg.inv(cross[k, k]) for k in range(len(frequencies))])
    order = np.argsort(frequencies, kind="stable")
    cells = spark.range(len(frequencies) * len(amplitudes) * phases).select(
        (F.col("id") / (len(amplitudes) * phases)).cast("int").alias("f"), (F.floor(F.col("id") / phases) % len(amplitudes)).cast("int").alias("a"), (F.col("id") % phases).cast("int").alias("q")
    )

    def run(frames):
        for g in frames:
            rows = []
            for f, a, q in zip(g.f, g.a, g.q):
                angle = 2 * math.pi * q / phases
                s = score + cross[:, f] @ (amplitudes[a] * np.array([math.cos(angle), math.sin(angle)]))
                stats = np.einsum("ki,kij,kj->k", s, inverse, s)
                passed = bool(stats[f] >= critical)
                rows.append((frequencies[f], amplitudes[a], passed, passed and bool(order[np.argmax(stats[order])] == f)))
            yield pd.DataFrame(rows, columns=["frequency", "amplitude", "d", "w"])

    made = cells.mapInPandas(run, "frequency double, amplitude double, d boolean, w boolean")
    return made.groupBy("frequency", "amplitude").agg((F.count_if("d") / phases).alias("detected"), (F.count_if("w") / phases).alias("identified"))
