"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of test questions and answers.

Texts are normalised to words between single spaces: A-Z in lower case, anything else in ASCII but digits and letters
parts words. A window is 10 consecutive words of an item, or all words of a shorter item. The automaton scans each
normalised text once, and where a window ends its words are hit; places go back to the original by the words' offsets."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import save, slices

WINDOW = 10
#: Bytes of windows and item ids that one automaton takes; it holds some fifty times as much.
PART_BYTES = 4 << 20
#: What each byte of a text becomes: a word's byte, or a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
_FOUND = "n_words bigint, n_hit bigint, hits array<struct<start:bigint,stop:bigint>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends, in code points of the text as it is."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # code points that start before a byte
    return before[np.flatnonzero(edge == 1)], before[np.flatnonzero(edge == -1)]


def _spelt(words: list[bytes]) -> str:
    """Words between spaces, a character for each byte."""
    return b" ".join([b"", *words, b""]).decode("latin-1")


def windows(bench: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """window (binary) and items (array of string) of all windows of a benchmark: `size` consecutive words of an item's text, or all
    words of a shorter one. Null and empty texts have none; a null item id is in no list, but its windows stand; rows of one
    item are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found: list[tuple[bytes, str | None]] = []
            for name, own in zip(batch.column("item").to_pylist(), map(words_of, batch.column("text").to_pylist())):
                found += [(b" ".join(own[i : i + size]), name) for i in range(max(1, len(own) - size + 1)) if own]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], names=["window", "item"])

    each = bench.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(run, "window binary, item string")
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


class Automaton:
    """Windows and their items, as they are sent; each worker builds the automaton from them once. No windows find nothing."""

    def __init__(self, found: list[tuple[bytes, list[str]]]):
        self.found = found

    def __getstate__(self) -> dict:
        return {"found": self.found}

    @functools.cached_property
    def made(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i, (window, _) in enumerate(self.found):
            out.add_word(_spelt([window]), (len(window) + 1, i))
        out.make_automaton()
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[str]]:
        """First words and ends (a word further) of all windows in a sequence of words, and the items of those windows."""
        ends = list(self.made.iter(_spelt(words))) if self.found and words else []
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), set()
        spaces = np.cumsum([0, *(len(w) + 1 for w in words)])
        stop = np.array([e for e, _ in ends], np.int64)
        start = stop - np.array([n for _, (n, _) in ends], np.int64)
        return np.searchsorted(spaces, start), np.searchsorted(spaces, stop), set().union(*(self.found[i][1] for i in {i for _, (_, i) in ends}))


def _covered(first: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, stop, -1)
    return np.cumsum(change[:-1]) > 0


def _scanner(part: Broadcast, last: bool, whole: bool):
    """Adds the windows of a part to __runs (first words and ends in turn) and items; the last part makes the results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            runs, items, n_words, n_hit, hits = [], [], [], [], []
            for text, before, known in zip(*(batch.column(c).to_pylist() for c in ("text", "__runs", "items"))):
                words = words_of(text)
                first, stop, own = part.value.scan(words)
                at = np.concatenate([np.array(before, np.int64).reshape(-1, 2), np.stack([first, stop], 1)])
                items.append(sorted(own.union(known)))
                if not last:
                    runs.append(at.ravel())
                    continue
                n_words.append(len(words))
                if not len(at):
                    n_hit.append(0)
                    hits.append([])
                    continue
                hit = _covered(at[:, 0], at[:, 1], len(words))
                edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                starts, ends = word_offsets(text)
                n_hit.append(int(hit.sum()))
                hits.append([{"start": a, "stop": b} for a, b in zip(starts[np.flatnonzero(edge == 1)].tolist(), ends[np.flatnonzero(edge == -1) - 1].tolist())])
            rest = [x for x in batch.schema.names if x not in ("__runs", "items") and (whole or not last or x != "text")]
            own = {"items": pa.array(items, pa.list_(pa.string()))}
            if last:
                own = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hits": pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), **own}
            else:
                own = {"__runs": pa.array([x.tolist() for x in runs], pa.list_(pa.int64())), **own}
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), *own.values()], names=[*rest, *own])

    return run


def scan(docs: DataFrame, bench: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES, whole: bool = True) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), hits (the runs of hit words: start and stop in code points
    of the original text) and items (item ids, as strings, with occurring windows, in order). Without `whole` the text is
    left out.

    Null and empty texts have no words; rows are judged one by one, so repeated rows are judged alike and a null doc_id
    is kept; a whole text, however long, is scanned at once. Other columns stay; ones named like results are replaced. An
    empty benchmark hits nothing.

    The windows go to the workers in a broadcast of about part_bytes at most. A larger benchmark is dealt out by
    hash into as many automata as that takes; documents pass them one after another, each pass written before the next."""
    known = save(windows(bench, size), "windows")
    bulk = F.length("window") + F.coalesce(F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x)), F.lit(0))
    parts = max(1, -(-(known.agg(F.sum(bulk)).first()[0] or 0) // part_bytes))
    rest = [c for c in docs.columns if c not in ("n_words", "n_hit", "hits", "items", "__runs")]
    out = docs.select(*[F.col(f"`{c}`") for c in rest], F.array().cast("array<bigint>").alias("__runs"), F.array().cast("array<string>").alias("items"))
    kept = docs.select(*[F.col(f"`{c}`") for c in rest if whole or c != "text"])
    for k in range(parts):
        own = known.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k) if parts > 1 else known
        sent = docs.sparkSession.sparkContext.broadcast(Automaton([(bytes(r.window), r["items"]) for r in own.collect()]))
        last = k == parts - 1
        names = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), _FOUND])
        passed = out.mapInArrow(_scanner(sent, last, whole), names if last else out.schema)
        out = passed if last else save(passed, "scanned")
    return out


def digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the comma-joined ids) and contaminated of every document."""
    found = scan(docs.select("doc_id", "text"), bench, whole=False)
    joined = F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


DIGEST_SQL = r"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM raw),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS win
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS p FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT n FROM k),
p AS (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, n WHERE len(ws) >= n),
m AS (SELECT r, p, p.n, item FROM p JOIN k ON k.n = p.n AND k.win = array_to_string(ws[p:p + p.n - 1], ' ')),
h AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS i FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
