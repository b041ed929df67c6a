"""The queries of this subpackage and their SQL, in the modules below."""

from __future__ import annotations

import public_tokenizers

from plumbline.llm import alignment, bpe, decontaminate, exact_dedup, idfile, importance, line_dedup, near_join, packing, quality, sharding, substring, topk
from plumbline.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_join(spark, sf_dir):
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return substring.digest(table(spark, sf_dir, "documents"))


def op6_id_files(spark, sf_dir):
    return idfile.read(idfile.write(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op8_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op10_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_decontamination(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), VOCABULARY, PIECES)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality, op3_near_join, op4_sharding, op5_substring_dedup, op6_id_files, op7_packing, op8_line_dedup, op9_exact_dedup, op10_topk, op11_decontamination, op12_importance, op13_alignment)}
ORACLES = {"op3_near_join": near_join.NEAR_SQL, "op5_substring_dedup": substring.DIGEST_SQL, "op8_line_dedup": line_dedup.DIGEST_SQL, "op9_exact_dedup": exact_dedup.MARK_SQL, "op10_topk": topk.TOP_SQL, "op11_decontamination": decontaminate.DIGEST_SQL, "op12_importance": importance.RESAMPLE_SQL}
