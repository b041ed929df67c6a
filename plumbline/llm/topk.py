"""Exact top-k inner products on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
CHUNK_QUERIES = 16_384
#: Components stay below this in magnitude, so that differences of two fit a long.
LARGEST = 1 << 62
#: Doubles of this size have no more than six bits of fraction.
WHOLE = float(1 << 47)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def bit_slices(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, ..., words): bitmap b holds bit b of each value along the last axis; 64 rows a word."""
    n = values.shape[-1]
    if values.dtype == object:
        planes = np.zeros((bits, *values.shape[:-1], -(-n // 64) * 64), np.uint8)
        for b in range(bits):
            planes[b, ..., :n] = ((values >> b) & 1).astype(np.uint8)
        return np.ascontiguousarray(np.packbits(planes, axis=-1, bitorder="little")).view("<u8")
    padded = np.zeros((*values.shape[:-1], -(-n // 64) * 64), np.int64)
    padded[..., :n] = values
    planes = ((padded[None] >> np.arange(bits, dtype=np.int64).reshape(-1, *[1] * padded.ndim)) & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(planes, axis=-1, bitorder="little")).view("<u8")


def wide_slices(values: np.ndarray) -> list[np.ndarray]:
    """The bitmaps of a row of non-negative integers of any length."""
    out: list[np.ndarray] = []
    while (values != 0).any():
        out += list(bit_slices((values % LARGEST).astype(np.int64), 62))
        values = values // LARGEST
    return out


def add_slices(total: list[np.ndarray], more: list[np.ndarray], shift: int = 0) -> list[np.ndarray]:
    """total + more * 2^shift, all bit-sliced: a ripple of full adders over whole bitmaps."""
    out, carry = list(total[:shift]), None
    while len(out) < shift:
        out.append(np.zeros_like(more[0]))
    for j in range(max(len(total) - shift, len(more))):
        a = total[shift + j] if shift + j < len(total) else None
        b = more[j] if j < len(more) else None
        if a is None or b is None:
            a = b if a is None else a
            out.append(a if carry is None else a ^ carry)
            carry = None if carry is None else a & carry
        else:
            half = a ^ b
            out.append(half if carry is None else half ^ carry)
            carry = a & b if carry is None else (a & b) | (half & carry)
    return out if carry is None else [*out, carry]


class Index:
    """The bit-sliced attributes of a block of vectors, made non-negative by one base for each dimension.

    Sums of all subsets of each six dimensions are kept bit-sliced, so that a query adds one subset's slices for
    each bit of its weights in place of each dimension's. Slices take sums of any length; what is added beside them is
    in Python's integers where it could pass a long."""

    GROUP = 6

    def __init__(self, vectors: np.ndarray):
        self.rows, self.vectors = len(vectors), vectors
        self.base = vectors.min(0)
        above = vectors - self.base
        self.bits = max(1, int(above.max(initial=0)).bit_length())
        slices = bit_slices(np.ascontiguousarray(above.T), self.bits)  # bits, dimensions, words
        self.tables = []
        for d in range(0, vectors.shape[1], self.GROUP):
            sums: list[list[np.ndarray]] = [[]]
            for k in range(d, min(d + self.GROUP, vectors.shape[1])):
                own = list(slices[:, k])
                sums += [add_slices(own, s) if s else own for s in sums]
            deep = max(len(s) for s in sums)
            empty = np.zeros_like(slices[0, 0])
            self.tables.append(np.stack([np.stack([*s, *[empty] * (deep - len(s))]) for s in sums], 1))  # slices, subsets, words

    def scores(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Bit-sliced scores, each a bitmap of (queries, words), of the queries' non-negative parts, and what to add."""
        low = np.minimum(queries.min(0), 0) if len(queries) else np.zeros(queries.shape[1], np.int64)
        weights = queries - low  # q.v = w.a + w.base + low.v: the last part differs by row and is added as one more attribute
        total: list[np.ndarray] = []
        for bit in range(max(1, int(weights.max(initial=0)).bit_length())):
            on = ((weights >> bit) & 1).astype(np.int64)
            part: list[np.ndarray] = []
            for g, table in enumerate(self.tables):
                code = on[:, g * self.GROUP : (g + 1) * self.GROUP]
                subset = code @ (1 << np.arange(code.shape[1]))
                part = add_slices(part, list(table[:, subset])) if part else list(table[:, subset])
            total = add_slices(total, part, bit) if total else part
        large = lambda x: np.abs(x.astype(float)).max(0, initial=0)
        wide = self.vectors.dtype == object or queries.dtype == object
        v, w = (0, 0) if wide else (large(self.vectors), large(weights))
        if not wide and (3 * v * w + v * np.abs(low.astype(float))).sum() < LARGEST / 2:
            vectors, base = self.vectors, self.base
        else:
            vectors, base, low, weights = (x.astype(object) for x in (self.vectors, self.base, low, weights))
        rest = vectors @ low
        extra = rest - rest.min(initial=0)
        if extra.any():
            planes = wide_slices(extra)
            total = add_slices(total, [np.broadcast_to(p, total[0].shape) for p in planes])
        return total, weights @ base + rest.min(initial=0)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, row number and score of each query's k best rows, ties to the earlier row. own: the row to
        leave out for each query, or -1."""
        slices, added = self.scores(queries)
        words = slices[0].shape[-1]
        last = np.full(words, _ONES)
        if self.rows % 64:
            last[self.rows // 64] = np.uint64((1 << self.rows % 64) - 1)
        maybe = np.repeat(last[None], len(queries), 0)
        has = own >= 0
        maybe[np.flatnonzero(has), own[has] // 64] &= ~(np.uint64(1) << (own[has] % 64).astype(np.uint64))
        sure = np.zeros_like(maybe)
        # from the most significant slice downward: sure rows are above the k-th score, maybe rows still level with it
        for s in reversed(slices):
            high = maybe & s
            enough = (np.bitwise_count(sure).sum(1, dtype=np.int64) + np.bitwise_count(high).sum(1, dtype=np.int64) >= k)[:, None]
            sure = np.where(enough, sure, sure | high)
            maybe = np.where(enough, high, maybe & ~s)
        # the boundary: rows level with the k-th score, the first ones by row
        q, r = self._rows(sure)
        need = k - np.bincount(q, minlength=len(queries))
        bq, br = self._rows(maybe)
        place = np.arange(len(bq)) - np.searchsorted(bq, bq)
        pick = place < need[bq]
        q, r = np.concatenate([q, bq[pick]]), np.concatenate([r, br[pick]])
        score = added[q].copy()
        for j, s in enumerate(slices):
            score += ((s[q, r // 64] >> (r % 64).astype(np.uint64)) & np.uint64(1)).astype(score.dtype) << j
        return q, r, score

    @staticmethod
    def _rows(bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, w = np.nonzero(bitmap)
        bits = np.unpackbits(bitmap[q, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return q[at], w[at] * 64 + bit


def quantised(vector: Column) -> Column:
    """floor(64 x) / 64 of each component, which a double holds for every finite x; null unless all are finite numbers."""
    real = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(real, lambda x: F.when(F.abs(x) < WHOLE, F.floor(x * 64) / 64.0).otherwise(x)))


def whole_numbers(quantised: np.ndarray) -> np.ndarray:
    """64 times quantised components: as longs, or as Python's integers where one is too large for the index's arithmetic in longs."""
    if np.abs(quantised).max(initial=0) < LARGEST // 64:
        return (quantised * 64).astype(np.int64)
    flat = [int(x * 64) if abs(x) < WHOLE else int(x) * 64 for x in quantised.ravel().tolist()]
    return np.array([*flat, None], object)[:-1].reshape(quantised.shape)


def top_k(df: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", key: str = "vec_id", block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row whose key is divisible by `every`, the k other rows of
    greatest integer inner product of quantised vectors; ties go to the smaller key.

    Rows of null key, null vectors, and vectors with null or non-finite components take no part; all others do, however large their
    components are. A score among the answers that does not fit a long is an error. Shorter vectors, empty ones too, count as zero in what they lack. Rows of one key ask
    once, with the least of their vectors; every row is a candidate, repeated ones as often as they stand, but no row of the
    query's own key. Other
    columns are not read.

    Rows are dealt into blocks and queries into chunks by hash; one task indexes one block and answers one chunk, so
    memory is bounded, and each query gets at most k rows from a block. A block's index is built once for each chunk of
    16,384 queries, so that its cost is small beside theirs."""
    rows = df.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").groupBy("id", "v").agg(F.count("*").alias("copies"))
    n, least, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = max(most, 1)
    if least < most:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v"))))
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-(n // every + 1) // chunk_queries))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    left = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asks"), "id", "v", F.least("copies", F.lit(k)).cast("int").alias("copies"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("asks"), "id", "v", F.lit(1).alias("copies"))

    def answer(group: pa.Table) -> pa.Table:
        ids, asks = group["id"].to_numpy(), group["asks"].to_numpy()
        flat = group["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids[~asks], kind="stable")
        rid, vectors, copies = ids[~asks][order], whole_numbers(flat[~asks][order]), group["copies"].to_numpy()[~asks][order]
        qid, asked = ids[asks], whole_numbers(flat[asks])
        out: list[tuple] = []
        if len(rid) and len(qid):
            index = Index(vectors)
            first, after = np.searchsorted(rid, qid), np.searchsorted(rid, qid, "right")
            spare = int((after - first).max())  # own rows beyond the first are dropped after the search
            for a in range(0, len(qid), 128):
                own = np.where(after > first, first, -1)[a : a + 128]
                q, r, s = index.top(asked[a : a + 128], own, k + max(spare - 1, 0))
                q = q + a
                keep = rid[r] != qid[q]
                out.append((qid[q][keep], rid[r][keep], s[keep], copies[r][keep]))
        parts = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4)]
        score, low = parts[2], np.zeros(len(parts[2]), bool)
        if score.dtype == object:  # what is too high is among the answers, or others too high are; what is too low need not be
            if any(x >= 1 << 63 for x in score):
                raise OverflowError("a score does not fit a long")
            low = np.array([x < -(1 << 63) for x in score], bool)
            score = np.where(low, 0, score).astype(np.int64)
        return pa.table({"query_id": parts[0], "vec_id": parts[1], "score": pa.array(score, mask=low), "copies": parts[3].astype(np.int32)})

    found = left.unionByName(right).groupBy("block", "chunk").applyInArrow(answer, "query_id long, vec_id long, score long, copies int")
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))))  # k at most: no more can be ranked
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    held = F.coalesce("score", F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", held.alias("score"))


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
