"""Exact deduplication by deterministic block naming. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, drop_saved, save

BLOCK_CHARS = 512


def _named(parts: DataFrame, content: list[str], tag: str) -> DataFrame:
    """unit, pos and name: parts (unit, pos, *content) with each distinct content in place of an integer.

    The distinct contents are sorted over all partitions, by a hash of the whole content and then by the content itself, so that no
    common beginning fills a range; names ascend in that order. They are written once, so that a task that runs again finds the
    same ones."""
    distinct = parts.select(*content).distinct().withColumn("h", F.xxhash64(*content))
    # ranges by the hash alone: equal contents are one row, and the driver's sample for the ranges is of numbers
    ordered = distinct.repartitionByRange("h").sortWithinPartitions("h", *content)
    names = save(ordered.select(*content, F.monotonically_increasing_id().alias("name")), tag)
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")) for c in content]
    return parts.alias("p").join(names.alias("n"), on).select("p.unit", "p.pos", "n.name")


def _blocks(body: str, block_chars: int) -> tuple[Column, Column]:
    """The number of blocks of a body (one at least), and the blocks."""
    count = F.greatest(F.ceil(F.length(body) / block_chars), F.lit(1)).cast("int")
    return count, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col(body), i * block_chars + 1, F.lit(block_chars)))


def identities(units: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """unit and identity (struct of blocks and name) of units (unit, body): equal bodies and no others share one.

    A body is cut into blocks of block_chars code points, and the blocks get integer names; then each two adjacent
    names are one pair, and the distinct pairs get names, until one name is left. An odd last name is paired with
    null. Bodies of different numbers of blocks never share an identity, as that number is part of it."""
    blocks, cut = _blocks("body", block_chars)
    parts = units.select("unit", F.posexplode(cut).alias("pos", "content"))
    named = save(_named(parts, ["content"], "block-names"), "named0")
    longest = named.agg(F.max("pos")).first()[0] or 0
    level = 0
    while longest > 0:
        level += 1
        pair = named.groupBy("unit", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"))
        # the odd last ones are paired with null: null-safe joins have a key for them
        before, named, longest = named, save(_named(pair, ["a", "b"], "pair-names"), f"named{level}"), longest // 2
        drop_saved(before)
    return named.join(units.select("unit", blocks.alias("blocks")), "unit").select("unit", F.struct("blocks", "name").alias("identity"))


def _with_lone_block(bodies: DataFrame, block_chars: int) -> DataFrame:
    """unit of the bodies (unit, body) that have a block which no other body has at its place, by a 64-bit hash, which can
    only hide that: the block's name would be theirs alone, so they have no copy."""
    blocks, cut = _blocks("body", block_chars)
    parts = bodies.select("unit", blocks.alias("blocks"), F.posexplode(cut).alias("pos", "content"))
    hashed = save(parts.select("unit", F.xxhash64("blocks", "pos", "content").alias("h")), "block-hashes")
    once = hashed.groupBy("h").agg(F.count("*").alias("n"), F.min("unit").alias("unit")).where("n = 1")
    return save(once.select("unit").distinct(), "lone")


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Texts are equal when the same after white space (space, tab to carriage return) is deleted; null is empty. Of
    equal texts the row with the most code points in its original text, then the smallest key, stays; a null key
    comes last. Rows alike in key and original length share keep_id; one of them is kept. group_size counts rows. Other
    columns are not read.

    Names decide what is equal. A document with a block of its own has no copy, so the others alone are named to the
    end. SHA-256 is only an output."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE + "+", "")
    rows = docs.select(F.col(key).alias("k"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"), body.alias("body"))
    # a row is named by its number in the written table, which stays
    rows = save(rows.select(F.monotonically_increasing_id().alias("unit"), "k", "chars", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), "body"), "bodies")
    lone = _with_lone_block(rows.select("unit", "body"), block_chars)
    # joined by sort and merge at every size: both sides grow with the documents
    bodies = save(rows.select("unit", "body").join(lone.hint("merge"), "unit", "left_anti"), "named-bodies")
    slim = rows.select("unit", "k", "chars", "sha")
    known = save(slim.join(identities(bodies, block_chars).hint("merge"), "unit"), "known")
    first = F.struct((-F.col("chars")).alias("c"), F.col("k").isNull().alias("nil"), F.col("k").alias("k"), F.col("unit").alias("unit"))
    groups = save(known.groupBy("identity").agg(F.min(first).alias("best"), F.count("*").alias("group_size")), "groups")
    copies = known.join(groups, "identity").select(F.col("k").alias(key), F.col("best.k").alias("keep_id"), "group_size", (F.col("unit") == F.col("best.unit")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = slim.join(lone.hint("merge"), "unit", "left_semi").select(F.col("k").alias(key), F.col("k").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(copies)


MARK_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body)::BIGINT AS group_size,
       row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id)
"""
