"""Connected components of an edge table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop_saved, save


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for every node of edges (a, b); loops and repeats are fine.

    Alternates two steps until nothing changes: each node links its larger neighbours to its least one, then its
    smaller ones and itself. Rounds grow with the logarithm of a component's size. Minima are pre-aggregated, so that a
    node with many neighbours is no large group, and written, so that both sides of a join are plain exchanges, of which AQE
    splits the skewed partitions; the joins have a row for each edge."""
    now = save(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = save(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "least-of-all")
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = save(large, "large-star")
        drop_saved(least)
        least = save(large.groupBy("v").agg(F.min("u").alias("m")), "least-of-large")
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        small = save(small, "small-star")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for table in (now, large, least):
            drop_saved(table)
        now = small
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
