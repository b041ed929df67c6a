"""A uniform shuffle into shards of exact sizes, by a communication matrix of hypergeometric counts.

DataFrame functions only. Blocks of rows stand for the partitions of the method: a row's block is a hash of its key
columns, so that a task that runs again deals the same rows alike."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import save

BLOCK_ROWS = 20_000


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _log_factorial(n: Column) -> Column:
    """Exact up to 20, then Stirling's series to the fifth power (below 1e-12 off)."""
    x = F.greatest(n, _long(21)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, _long(20)).cast("int")).cast("double"))).otherwise(series)


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(draws: Column, good: Column, bad: Column, u: Column) -> Column:
    """How many of `draws` rows drawn without replacement are among the `good`, for a uniform u in [0, 1): the
    inverse of the distribution function. Weights are summed over the support within 12 standard deviations plus
    30 of the mean; what lies beyond is below the precision of a double."""
    names = ("draws", "good", "bad")
    return _let(F.struct(*[c.cast("long").alias(k) for c, k in zip((draws, good, bad), names)]), lambda r: _inverse(*[r[k] for k in names], u))


def _inverse(draws: Column, good: Column, bad: Column, u: Column) -> Column:
    """hypergeometric() of variables: each step is bound to a variable of its own, so that the expression stays small."""
    total = good + bad
    mean = draws * good / F.greatest(total, _long(1))
    variance = lambda m: m * (bad / F.greatest(total, _long(1))) * ((total - draws) / F.greatest(total - 1, _long(1)))
    moments = _let(mean, lambda m: F.struct(m.alias("mean"), F.sqrt(F.greatest(variance(m), F.lit(0.0))).alias("spread")))
    low = lambda m: F.greatest(draws - bad, _long(0), F.floor(m["mean"] - 12 * m["spread"] - 30).cast("long"))
    high = lambda m: F.least(draws, good, F.ceil(m["mean"] + 12 * m["spread"] + 30).cast("long"))
    log_weight = lambda k: -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(draws - k) + _log_factorial(bad - draws + k))

    def pick(weights: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), _long(0).alias("k"))
        below = lambda most: lambda a, w: F.struct((a["sum"] + w).alias("sum"), (a["k"] + F.when(a["sum"] + w <= most, 1).otherwise(0)).cast("long").alias("k"))
        return _let(u * F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), lambda most: F.aggregate(weights, start, below(most))["k"])

    def within(b: Column) -> Column:
        middle = F.least(F.greatest(F.round(b["mean"]).cast("long"), b["low"]), b["high"])
        weights = _let(_let(middle, log_weight), lambda top: F.transform(F.sequence(b["low"], b["high"]), lambda k: F.exp(log_weight(k) - top)))
        return F.when(b["low"] >= b["high"], b["low"]).otherwise(F.least(b["low"] + _let(weights, pick), b["high"]))

    return _let(moments, lambda m: _let(F.struct(m["mean"].alias("mean"), low(m).alias("low"), high(m).alias("high")), within))


def _draw_row(node: Column, left: Column, capacity: Column, shards: int, seed: int) -> Column:
    """For the `left` rows of a node's first half: how many go to each shard, given what the node owes each."""
    start = F.struct(left.alias("draws"), F.aggregate(capacity, _long(0), lambda a, x: a + x).alias("total"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, j: Column) -> Column:
        good = F.element_at(capacity, j)
        u = F.shiftrightunsigned(F.xxhash64(_long(seed), node, j), 11) / F.lit(float(1 << 53))
        drawn = _let(hypergeometric(a["draws"], good, a["total"] - good, u), lambda x: F.struct((a["draws"] - x).alias("draws"), (a["total"] - good).alias("total"), F.concat(a["out"], F.array(x)).alias("out")))
        return drawn

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["out"]


def communication_matrix(counts: DataFrame, levels: int, sizes: list[int], seed: int) -> DataFrame:
    """block and to_shard: an array of how many of the block's rows go to each shard. counts: block, n for blocks
    0 to 2^levels - 1 (absent ones are empty). Rows of the matrix add up to n, columns to sizes. The blocks are
    halved level by level; each halving is one vector of hypergeometric draws, made where the node's row is."""
    spark = counts.sparkSession
    # a node is numbered as in a heap, so that its number alone seeds its draws
    nodes = spark.range(1, 2).select(F.col("id").alias("node"), F.array(*[_long(x) for x in sizes]).alias("to_shard"))
    drawn = _draw_row(F.col("node"), F.col("left"), F.col("to_shard"), len(sizes), seed)
    halves = F.inline(
        F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("x").alias("to_shard")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("to_shard", "x", lambda a, b: a - b).alias("to_shard")),
        )
    )
    in_first = F.sum(F.when(F.col("half") % 2 == 0, F.col("n")).otherwise(0)).alias("left")
    for level in range(levels):
        first = counts.select((F.shiftright("block", levels - level) + (1 << level)).alias("node"), F.shiftright("block", levels - level - 1).alias("half"), "n").groupBy("node").agg(in_first)
        nodes = nodes.join(first, "node").select("node", "to_shard", drawn.alias("x")).select(halves)
        if level % 2 and level + 1 < levels:
            nodes = save(nodes, "nodes")  # keeps plans short
    return nodes.select((F.col("node") - (1 << levels)).alias("block"), "to_shard")


def shuffle_shards(df: DataFrame, key: list[str], shards: int = 24, seed: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in its shard): a uniform shuffle whose shard sizes
    differ by one row at most; the first shards get the odd rows.

    key: columns that tell rows apart, nulls among them allowed. Rows equal in all key columns are
    interchangeable: each gets its own slot. Fewer rows than shards leave the last shards empty; an empty table
    stays empty. Columns of df named shard or slot are replaced. No group is larger than a block: a shard is
    numbered by sub-shards, whose offsets come from their counts."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    key_hash = lambda part: F.xxhash64(_long(seed), _long(part), *[F.col(k) for k in key], *[F.col(k).isNull() for k in key])
    n = df.count()
    levels = max(6, math.ceil(math.log2(max(n, 1) / block_rows + 1)))
    subs = 1 << max(3, math.ceil(math.log2(max(n, 1) / shards / block_rows + 1)))
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    rows = df.withColumn("__block", F.pmod(key_hash(0), _long(1 << levels)))
    counts = save(rows.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n")), "block-counts")
    matrix = save(communication_matrix(counts, levels, sizes, seed), "matrix")
    # permute locally, and cut the permuted block by its row of the matrix
    local = Window.partitionBy("__block").orderBy(key_hash(1), *key)
    ends = F.aggregate(F.col("to_shard"), F.struct(_long(0).alias("sum"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out")))["out"]
    cuts = matrix.select(F.col("block").alias("__block"), ends.alias("__ends"))
    placed = rows.withColumn("__at", F.row_number().over(local)).join(cuts, "__block")
    placed = placed.withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__at")))).drop("__ends", "__at", "__block")
    # exchange by shard and sub-shard, and permute again
    placed = placed.withColumn("__sub", F.pmod(key_hash(2), _long(subs)))
    whole = placed.groupBy("shard", "__sub").agg(F.count("*").alias("__n"))
    offsets = whole.withColumn("__start", F.sum("__n").over(Window.partitionBy("shard").orderBy("__sub")) - F.col("__n")).drop("__n")
    inner = Window.partitionBy("shard", "__sub").orderBy(key_hash(3), *key)
    numbered = placed.withColumn("__at", F.row_number().over(inner)).join(save(offsets, "offsets"), ["shard", "__sub"])
    return numbered.withColumn("slot", F.col("__start") + F.col("__at") - 1).select(*df.columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """The rows law for documents: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: no key law).

    Every row of docs gets one slot: rows of one id, of none, and rows alike in everything too. A null text has no bytes; other
    columns are not read; an empty table gives no rows. A row is dealt by its number in a table that is written first, so
    that repeated rows are many keys, not one, and a task that runs again deals alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_shards(save(rows, "sharded-rows"), ["row"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
