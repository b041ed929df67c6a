"""Token ids in keyed binary shards: raw payloads, and a minimal perfect hash of document keys to offsets.

A part of a shard is one record of a Parquet table, which Spark's own writer puts into any store. Binary columns end at
2 GB, so a text has fewer than 2^29 tokens:

    shard    int     shards ascend by key
    part     int     parts of a shard; a part holds about PART_BYTES of payload and PART_KEYS documents at most, one at least
    payload  binary  the ids of all its documents, each with its end id, little-endian, `width` bytes an id
    low, high long   keys of the first and last document, null as the least long
    keys     binary  int64[documents]: the keys in ascending order, for reading all documents in turn; lookups
                     do without them
    header   binary  int64 x 5: documents, distinct keys, buckets, width, seed of the hash; then
                     int64[documents + 1]  where each document's ids start, in ids
                     uint16[buckets]       displacement of each bucket of the hash
                     uint32[keys]          by slot: fingerprint of the key
                     uint32[keys]          by slot: number of the first document of the key
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.common import save, slices

PART_BYTES = 1 << 20
#: The more keys, the likelier that a seed fails: about one time in fifty here.
PART_KEYS = 1 << 14
#: Words of known ids in a worker, which also holds a part and sorts its shard.
CACHED_WORDS = 400_000
#: Seeds of a perfect hash, each with hashes of its own.
SEEDS = 256
_SEED = 1 << 21
#: Keys times displacements that are tried at once.
_TRIALS = 1 << 12
_NULL = -(1 << 63)
#: A row is a megabyte: the writer looks at its size after each, and a reader's task gets a few.
_SMALL_GROUPS = {"parquet.block.size": str(8 * PART_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "2"}
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of int64 keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Displacements for distinct keys, and a seed: a key's bucket is mix(key, base) mod buckets with base = seed * 2^21, its
    slot mix(key, base + displacement of the bucket + 1) mod n; no two keys share a slot. Where a bucket finds no place
    the next seed is tried."""
    for seed in range(SEEDS):
        moved = _displacements(keys, seed * _SEED)
        if moved is not None:
            return moved, seed
    raise ValueError("no seed fits: are the keys distinct?")


def _displacements(keys: np.ndarray, seed: int) -> np.ndarray | None:
    """Large buckets are placed first, all of one size together: of those that fit at a displacement the ones that share no slot
    stay there, the others go on to the next. None where a bucket fits at no displacement."""
    n = len(keys)
    buckets = max(1, -(-n // 3))
    bucket = (mix(keys, seed) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sizes = np.diff(cuts)
    moved, taken, owner = np.zeros(buckets, np.uint16), np.zeros(n, bool), np.zeros(n, np.int64)
    for size in range(int(sizes.max(initial=0)), 0, -1):
        left = np.flatnonzero(sizes == size)
        base = 0
        while len(left) and base < 1 << 16:
            own = keys[order[cuts[left][:, None] + np.arange(size)]]
            wide = min(max(1, _TRIALS // own.size), (1 << 16) - base)  # the fewer are left, the more displacements at once
            trial = np.arange(base + 1, base + wide + 1)
            slots = (mix(own[:, None, :], trial[None, :, None] + seed) % np.uint64(n)).astype(np.int64)
            free = ~taken[slots].any(2)
            if size > 1:
                free &= (np.diff(np.sort(slots, 2), axis=2) != 0).all(2)
            fits = np.flatnonzero(free.any(1))
            at = free[fits].argmax(1)
            wanted = slots[fits, at]
            owner[wanted] = fits[:, None]  # one of those that want a slot
            won = (owner[wanted] == fits[:, None]).all(1)
            moved[left[fits[won]]] = base + at[won]
            taken[wanted[won]] = True
            lost = np.ones(len(left), bool)
            lost[fits[won]] = False
            # those that lost a slot try the same displacements again, among which the next may fit
            base, left = (base + wide if won.all() else base), left[lost]
        if len(left):
            return None
    return moved


def slots(keys: np.ndarray, moved: np.ndarray, seed: int, n: int) -> np.ndarray:
    own = moved[(mix(keys, seed * _SEED) % np.uint64(len(moved))).astype(np.int64)].astype(np.int64)
    return (mix(keys, own + (seed * _SEED + 1)) % np.uint64(n)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def write_part(keys: np.ndarray, payloads: list[bytes], width: int) -> tuple[bytes, bytes]:
    """Payload and header of documents in ascending key order; rows of one key stand together."""
    distinct, first = np.unique(keys, return_index=True)
    moved, seed = perfect_hash(distinct)
    slot = slots(distinct, moved, seed, len(distinct))
    prints, number = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    prints[slot], number[slot] = fingerprints(distinct), first
    starts = np.cumsum([0, *map(len, payloads)]) // width
    head = np.array([len(keys), len(distinct), len(moved), width, seed], np.int64)
    return b"".join(payloads), b"".join(x.tobytes() for x in (head, starts.astype(np.int64), moved, prints, number))


class Part:
    """Constant-time keyed access to one part."""

    def __init__(self, payload: bytes, header: bytes):
        n, m, b, self.width, self.seed = np.frombuffer(header, np.int64, 5).tolist()
        at = 40
        take = lambda kind, count: np.frombuffer(header, kind, count, at)
        self.starts, at = take(np.int64, n + 1), at + 8 * (n + 1)
        self.moved, at = take(np.uint16, b), at + 2 * b
        self.prints, at = take(np.uint32, m), at + 4 * m
        self.first = take(np.uint32, m)
        self.ids = np.frombuffer(payload, f"<u{self.width}")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the first document of each key, or -1 where the fingerprint tells that there is none."""
        slot = slots(keys, self.moved, self.seed, len(self.prints))
        return np.where(self.prints[slot] == fingerprints(keys), self.first[slot].astype(np.int64), -1)

    def of(self, key: int) -> np.ndarray | None:
        """The ids of the (first) document of a key."""
        i = int(self.find(np.array([key]))[0])
        return None if i < 0 else self.ids[self.starts[i] : self.starts[i + 1]]


def write(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 0, shard_rows: int = 10_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written shards (shard, part, docs, ids, low, high, payload, keys, header) of all documents in ascending key order.

    A null text has the end id alone; a null key comes first; rows of one key stand together, in the order of the table.
    Other columns are not read. Shards are Spark's range partitions by key and row, with about shard_rows documents each,
    so many rows of one key, or of none, are several shards. Parts, not shards, bound what is in memory at once."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = max(8, -(-docs.count() // shard_rows))
    kind = np.dtype(bpe.library_type(vocabulary))
    fields = "shard int, part int, docs long, ids long, low long, high long, payload binary, keys binary, header binary"
    names = [x.split()[0] for x in fields.split(", ")]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = bpe.library_coder(vocabulary, pattern, CACHED_WORDS), np.array([end_id], kind).tobytes()
        shard = TaskContext.get().partitionId()
        keys: list[int] = []
        raws: list[bytes] = []
        part, held = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, raws, part, held
            if keys:
                payload, header = write_part(np.array(keys, np.int64), raws, kind.itemsize)
                row = (shard, part, len(keys), len(payload) // kind.itemsize, keys[0], keys[-1], payload, np.array(keys, "<i8").tobytes(), header)
                yield pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 3)))], names=names)
                keys, raws, part, held = [], [], part + 1, 0

        for batch in slices(batches, "text"):
            for k, raw in zip(batch.column("doc_id").to_pylist(), coder(batch.column("text").to_pylist())):
                if held + len(raw) + len(end) > PART_BYTES or len(keys) == PART_KEYS:
                    yield from flush()
                keys.append(k)
                raws.append(raw + end)
                held += len(raws[-1])
        yield from flush()

    # dealt by key and row alone, so that the sample for the ranges reads no texts
    ordered = rows.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return save(ordered.mapInArrow(parts, fields), "idfile", **_SMALL_GROUPS)


def part_starts(parts: DataFrame, span: int = 1024) -> DataFrame:
    """shard, part and start: the ids of all parts before. Sums go by spans of shards, so no task has all parts."""
    slim = parts.select("shard", "part", "ids", F.floor(F.col("shard") / span).cast("int").alias("span"))
    spans = slim.groupBy("span").agg(F.sum("ids").alias("n"))
    before = spans.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before"))  # a row for each 1024 shards
    inner = F.sum("ids").over(Window.partitionBy("span").orderBy("shard", "part")) - F.col("ids")
    return slim.withColumn("inner", inner).join(before, "span").select("shard", "part", (F.col("before") + F.col("inner")).alias("start"))


def read(parts: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (as uint32) of each document, looked up by
    its key in the part that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.library_coder.cache_clear()  # a worker that has encoded needs its words no more
        for batch in batches:
            for shard, no, payload, names, header in zip(*(batch.column(x) for x in ("shard", "part", "payload", "keys", "header"))):
                part, keys = Part(payload.as_py(), header.as_py()), np.frombuffer(names.as_py(), "<i8")
                found = part.find(keys)
                found += np.arange(len(found)) - np.searchsorted(keys, keys)  # later rows of one key follow the first
                a, b = part.starts[found], part.starts[found + 1]
                wide = memoryview(part.ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(wide[i:j]) for i, j in zip((4 * a).tolist(), (4 * b).tolist())]
                ids = pa.array(keys, pa.int64(), mask=keys == _NULL)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(a), pa.int32()), pa.array([no.as_py()] * len(a), pa.int32()), ids, pa.array(a), pa.array(b - a), pa.array(crcs, pa.int64())], names=["shard", "part", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = parts.select("shard", "part", "payload", "keys", "header").mapInArrow(run, "shard int, part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(part_starts(parts), ["shard", "part"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(parts: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ids (array of ids with the end id) of each distinct key of `keys`: its first document's; null where no
    document has the key. A null key finds the first document without one. Other columns of keys are not read.

    A key's shard comes from the shards' first keys (one number a shard, in a broadcast); its parts there from their
    bounds; the rest is the part's hash. Only parts that can hold a key are read, without their own lists of keys."""
    wanted = keys.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("k")).distinct()
    bounds = parts.groupBy("shard").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("shard").toPandas()
    shard, low, high = (keys.sparkSession.sparkContext.broadcast(bounds[x].to_numpy()) for x in ("shard", "low", "high"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            at = np.searchsorted(high.value, k)  # the first shard that ends at the key or after it
            fits = at < len(high.value)
            fits[fits] = low.value[at[fits]] <= k[fits]
            yield pa.RecordBatch.from_arrays([pa.array(k[fits]), pa.array(shard.value[at[fits]].astype(np.int32))], names=["k", "shard"])

    def find(_: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        k, ids = asked["k"].to_numpy(), []
        for payload, header in zip(held["payload"], held["header"]):
            part = Part(payload.as_py(), header.as_py())
            found = part.find(k)
            ids = [part.ids[part.starts[i] : part.starts[i + 1]].tolist() if i >= 0 else None for i in found.tolist()]
        return pa.table({"k": pa.array(k), "ids": pa.array(ids or [None] * len(k), pa.list_(pa.int64()))})

    slim = parts.select("shard", "part", "low", "high")
    placed = wanted.mapInArrow(place, "k long, shard int").join(slim, "shard").where("k BETWEEN low AND high").groupBy("k", "shard").agg(F.min("part").alias("part"))
    placed = save(placed, "placed-keys")
    held = parts.select("shard", "part", "payload", "header").join(placed.select("shard", "part").distinct(), ["shard", "part"], "left_semi")
    found = placed.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(find, "k long, ids array<long>")
    return wanted.join(found, "k", "left").select(F.when(F.col("k") != _NULL, F.col("k")).alias(key), "ids")
