"""A training corpus from raw documents: quality, line, near-duplicate and substring filters, then packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, near_join, packing, quality, substring
from plumbline.llm.common import BATCHES, save, table

THRESHOLD = 0.3
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _rewritten(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], text: Column) -> DataFrame:
    """docs with a new text, made by an operator from doc_id and text, and its n_chars, if there is such a column. Other columns stay as
    they are, whatever the operator calls its own: they pass it as one."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(True).alias("__"), *[F.col(f"`{c}`") for c in rest]).alias("__rest"))
    out = operator(packed).withColumn("text", text)
    kept = {c: F.length("text").cast("long") if c == "n_chars" else F.col(f"__rest.`{c}`") for c in rest}
    return out.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in docs.columns])


def _in_small_batches(spark: SparkSession) -> None:
    """The job's session sends small batches to Python from here on: whoever writes what a stage returns runs its last step."""
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more (null and empty texts are scored too)."""
    _in_small_batches(spark)
    model = quality.train_on(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="__score").where(F.col("__score") >= THRESHOLD).select(*docs.columns)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document has."""
    return _rewritten(docs, line_dedup.dedup_lines, F.col("kept_text"))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class of near duplicates. Rows of one doc_id are told apart by their texts: each is
    kept or goes by its own class. A null doc_id is the smallest, so its rows stay."""
    found = near_join.near_duplicates(docs.select("doc_id", "text"), text_hash=True)
    others = found.where("NOT doc_id <=> class_id").select("doc_id", F.col("text_hash").alias("__h")).distinct()
    return docs.withColumn("__h", F.xxhash64("text")).join(save(others, "near-duplicates"), ["doc_id", "__h"], "left_anti").select(*docs.columns)


def substring_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of passages that an earlier document has; untouched texts stay as they are."""
    _in_small_batches(spark)
    return _rewritten(docs, substring.remove_spans, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("substring dedup", substring_filter),
    ("packing", pack),
]

#: SQL cannot fit the classifier; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
