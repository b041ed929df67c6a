"""Importance resampling towards a target: bags of hashed word runs, log ratios of their shares, and Gumbel's trick.

A vectorised automaton reads the bytes of a whole Arrow buffer: a lookup table tells words from what parts them and lowers
A-Z, differences of that give the words' bounds, and table-driven CRCs advance by one byte across all words at once."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import numbered, save, slices

BUCKETS = 10_000
SEED = 2024
#: A word's byte in lower case; 0 parts words.
CLASSES = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0 for b in range(256)], np.uint8)
#: Words still under way below which each is finished by itself.
FEW = 16
_ONES = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """The reflected CRC-32 of each byte, from the polynomial's bits."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (out >> np.uint32(1))
    return out


_CRC = crc_table()


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states (not inverted) after data[start : start + length], a byte of all words at a time, the long words first."""
    order = np.argsort(-length, kind="stable")
    out, at, left = state[order], start[order], length[order]
    going, k = len(order), 0
    while True:
        going = int(np.searchsorted(-left[:going], -k, "left"))  # words longer than k
        if going < FEW:
            break
        now = out[:going]
        out[:going] = _CRC[(now ^ data[at[:going] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
        k += 1
    for i in range(going):
        out[i] = zlib.crc32(data[at[i] + k : at[i] + left[i]].tobytes(), int(out[i] ^ _ONES)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def runs(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to `most` words in each text of an Arrow column: the texts' numbers and the runs' CRC-32."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return
    data = CLASSES[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = data != 0
    open_, shut = inside.copy(), inside.copy()
    open_[1:] &= ~inside[:-1]
    shut[:-1] &= ~inside[1:]
    # a text ends its words
    bound = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    open_[bound], shut[bound - 1] = inside[bound], inside[bound - 1]
    start = np.flatnonzero(open_)
    length = np.flatnonzero(shut) + 1 - start
    text = np.searchsorted(offsets, start, "right") - 1
    state = advance(np.full(len(start), _ONES), data, start, length)
    yield text, state ^ _ONES
    for n in range(2, most + 1):
        # the run of n words from each place: the run of n - 1, a space, and one word more
        state = state[: max(len(start) - n + 1, 0)]
        fits = np.flatnonzero(text[n - 1 :] == text[: len(state)])
        spaced = _CRC[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state[fits] = advance(spaced[fits], data, start[fits + n - 1], length[fits + n - 1])
        yield text[fits], state[fits] ^ _ONES


def bucket_counts(df: DataFrame, buckets: int = BUCKETS, most: int = 1, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. A task adds up its own counts, so `buckets` rows a task at most
    are shuffled; the sums, one number a bucket, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for _, crc in runs(batch.column("text"), most):
                total += np.bincount(crc % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    found = df.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln of each bucket's smoothed share in the target over that in the source)."""
    buckets, t_all, s_all = len(target), int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + float(buckets)) / ((s + 1.0) * (t_all + float(buckets))))) for t, s in zip(target.tolist(), source.tolist())], np.int64)


def gumbel(key: int | None, seed: int) -> int:
    """A document's own draw, from its id and the seed alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, most: int = 1, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' other columns with n_words, n_features, weight (sum of the gains of all features; none: 0) and score (weight and the
    draw). The text is left out; columns named like results are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    made = ("n_words", "n_features", "weight", "score")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*made, text)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{c} bigint" for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in slices(batches, text):
            n = batch.num_rows
            counts, total = [np.zeros(n, np.int64)], np.zeros(n, np.int64)
            for row, crc in runs(batch.column(text), most):
                sums = np.concatenate([[0], np.cumsum(gain[crc % len(gain)])])
                cuts = np.searchsorted(row, np.arange(n + 1))
                total += np.diff(sums[cuts])
                counts.append(np.diff(cuts))
            n_words = counts[1] if len(counts) > 1 else counts[0]
            drawn = np.array([gumbel(k, seed) for k in batch.column(key).to_pylist()], np.int64)
            rest = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, (n_words, sum(counts), total, total + drawn))], names=[*rest, *made])

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made]).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, most: int = 1, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank. Of the N documents of least_words words and more the
    floor(percent * N / 100) of the highest scores are drawn, ties to the smaller doc_id, and get their ranks from 1; rank is null for
    the others.

    Null and empty texts have no features, weight 0 and are not drawn (where least_words is over 0). A null doc_id draws as an empty id and comes
    before others in ties; repeated rows are documents of their own and get ranks of their own. Counts are over all rows of
    both tables; an empty target leaves smoothing alone. Other columns are not read.

    Ranks are numbers in sampled ranges of the order, so no task has all documents, nor all of one score."""
    gain = gains(bucket_counts(target, buckets, most), bucket_counts(docs, buckets, most))
    # numbers within the written table tell repeated rows apart, so that many of them are many ranges
    found = save(weights(docs.select("doc_id", "text"), gain, most, seed).withColumn("__row", F.monotonically_increasing_id()), "weights")
    able = F.col("n_words") >= least_words
    drawn = percent * found.where(able).count() // 100
    ranked = numbered(found.where(able), [F.desc("score"), F.asc("doc_id"), F.asc("__row")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(found.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


RESAMPLE_SQL = r"""
WITH RECURSIVE poly(i, c, bit) AS (
  SELECT i, i::UINTEGER, 0 FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, bit + 1 FROM poly WHERE bit < 8),
crc AS MATERIALIZED (SELECT list(c::BIGINT ORDER BY i) AS c FROM poly WHERE bit = 8),
raw AS (SELECT true AS bench, 0 AS r, NULL::BIGINT AS doc_id, coalesce(text, '') AS t FROM benchmark
        UNION ALL SELECT false, row_number() OVER (), doc_id, coalesce(text, '') FROM documents),
d AS MATERIALIZED (SELECT bench, r, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM raw),
w AS MATERIALIZED (SELECT bench, r, unnest(ws) AS w FROM d),
b AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
                            lambda s, x: xor(c[xor(s & 255, x) + 1], s >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM w), crc),
n AS (SELECT bucket, count(*) FILTER (WHERE bench) AS t, count(*) FILTER (WHERE NOT bench) AS s FROM w JOIN b USING (w) GROUP BY bucket),
a AS (SELECT sum(t) AS tt, sum(s) AS ss FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM n, a),
v AS (SELECT r, sum(gain)::BIGINT AS weight FROM w JOIN b USING (w) JOIN g USING (bucket) WHERE NOT bench GROUP BY r),
x AS (SELECT doc_id, len(ws)::BIGINT AS n, coalesce(weight, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN v USING (r) WHERE NOT bench),
y AS (SELECT doc_id, n, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS k,
             count(*) OVER (PARTITION BY n >= 20) AS able FROM y)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND k <= 10 * able // 100 THEN k END AS rank FROM z
"""
