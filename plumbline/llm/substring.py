"""Substring deduplication: relative Lempel-Ziv parsing against indexed reference blocks.

A reference block is the part of the corpus whose 13-word windows have one anchor (their least hash of ANCHOR words).
Equal windows have equal anchors, so a document's factors of 13 words and more against every block are its factors against
the blocks of its own anchors: each run of windows with one anchor is sent to its block and to no other. A run that
stands whole in an earlier document is one factor at once. The other runs are parsed: the block's windows are indexed by
their earliest document, and from the first window that the index knows in an earlier one, the match is extended
for as long as both texts agree; the factor ends there, and the parse goes on at its boundary, where the windows that
cross it are looked up in turn. Factors that touch are joined into spans when they come back to the document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop_saved, in_groups, lists, save, slices
from plumbline.llm.grams import RunHash, run_starts, word_hashes

WINDOW = 13
ANCHOR = 5
BLOCK_RUNS = 8192
_NULL = -(1 << 63)


def _anchored(texts: list, window: int, anchor: int) -> tuple[RunHash, np.ndarray, np.ndarray, np.ndarray]:
    """The run hashes, the starts of all windows, their anchors, and where each text starts."""
    words, starts = word_hashes(texts)
    runs = RunHash(words)
    at = run_starts(starts, window)
    if not len(at):
        return runs, at, np.zeros(0, np.uint64), starts
    least = runs(np.arange(len(words) - anchor + 1), anchor)
    width = window - anchor + 1
    held = 1
    while held < width:  # least of held values from each place on
        step = min(held, width - held)
        least = np.minimum(least[: len(least) - step], least[step:])
        held += step
    return runs, at, least[at], starts


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, at, least, starts = _anchored(batch.column("text").to_pylist(), window, anchor)
            cuts = np.searchsorted(at, starts[1:-1])
            found = [np.unique(x) for x in np.split(least.view(np.int64), cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), lists(found, pa.int64())], names=["doc", "h", "anchors"])

    return run


def _runs(window: int, anchor: int):
    """For each document: runs of windows with one shared anchor (place, number of windows, anchor, hash of the
    content), and the hash of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, shared = batch.column("text").to_pylist(), batch.column("shared")
            hashes, at, least, starts = _anchored(texts, window, anchor)
            cuts = np.searchsorted(at, starts)
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                own, key = at[cuts[i] : cuts[i + 1]], least[cuts[i] : cuts[i + 1]]
                mask = np.isin(key.view(np.int64), shared[i].values.to_numpy())
                own, key = own[mask], key[mask]
                new = np.ones(len(own), bool)
                new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1] + 1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(own)))
                content = hashes(own[first], n + window - 1) if len(own) else key
                for column, x in zip(out, (own[first] - starts[i], n, key[first].view(np.int64), content.view(np.int64), hashes(own, window).view(np.int64) if len(own) else own)):
                    column.append(x)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            # a list of windows for each run, and a list of those for each document
            sizes = np.concatenate([*out[1], np.zeros(0, np.int64)]).astype(np.int64)
            each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(out[4]).astype(np.int64)))
            nested = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out[0])]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), *(lists(x, k) for x, k in zip(out, kinds)), nested], names=["doc", "h", "pos", "n", "anchor", "content", "windows"])

    return run


def factors(block: np.ndarray, doc: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of runs against the runs of their block: for each factor its run, its first window there, and its
    number of windows. Run r is windows[starts[r] : starts[r + 1]], of doc[r], in block[r]; references are runs of
    smaller documents."""
    total = len(windows)
    run = np.repeat(np.arange(len(doc)), np.diff(starts))
    owner, end = doc[run], starts[1:][run]
    order = np.lexsort((np.arange(total), owner, windows, block[run]))
    new = np.ones(total, bool)
    new[1:] = (windows[order][1:] != windows[order][:-1]) | (block[run][order][1:] != block[run][order][:-1])
    place = np.cumsum(new) - 1
    code, first = np.empty(total, np.int64), np.empty(total, np.int64)
    code[order], first[order] = place, order[np.flatnonzero(new)][place]  # the index: where a window stands first
    known = np.append(np.where(owner[first] < owner, np.arange(total), total), total)
    ahead = np.minimum.accumulate(known[::-1])[::-1]  # the next window that the index knows
    at = ahead[starts[:-1]]
    at = at[at < starts[1:]]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(at):
        source, n = first[at], np.ones(len(at), np.int64)
        going = np.arange(len(at))
        while len(going):
            p, q = at[going] + n[going], source[going] + n[going]
            inside = (p < end[at[going]]) & (q < end[source[going]])
            going, p, q = going[inside], p[inside], q[inside]
            going = going[code[p] == code[q]]
            n[going] += 1
        found.append((at, n))
        after = ahead[at + n]
        at = after[after < end[at]]  # on at the boundary, in the same run
    where, n = (np.concatenate(x) for x in zip(*found))
    return run[where], where - starts[run[where]], n


def _parsed(table: pa.Table) -> pa.RecordBatch:
    lists_ = table["windows"].combine_chunks()
    starts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists_), np.int64))]).astype(np.int64)
    docs, pos = table["doc"].to_numpy(), table["pos"].to_numpy()
    run, at, n = factors(table["anchor"].to_numpy(), docs, starts, lists_.flatten().to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(docs[run]), pa.array(table["h"].to_numpy()[run]), pa.array((pos[run] + at).astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "h", "pos", "n"])


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """doc, h and spans: for each document (doc: doc_id, null as the least long; h: a hash of its text) with
    duplicates, the places (start, n) whose windows start .. start + n - 1 have word sequences that also start in a
    smaller document. Rows of one id are one document: none makes a duplicate of another.

    A block of more than block_runs different runs is no task's: it is split into blocks of one window each, in which
    parsing is to take the least document of each window."""
    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), F.xxhash64("text").alias("h"), "text")
    anchors = save(rows.mapInArrow(_anchors(window, anchor), "doc long, h long, anchors array<long>"), "anchors")
    single = anchors.select("doc", "h", F.explode("anchors").alias("anchor"))
    # only anchors of several documents can belong to duplicates
    shared = save(single.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("anchor"), "shared-anchors")
    # by text, as rows of one id, or of none, may be many: a list has a text's own anchors
    by_doc = save(single.join(shared, "anchor", "left_semi").groupBy("doc", "h").agg(F.collect_set("anchor").alias("shared")), "doc-anchors")
    drop_saved(anchors)
    runs = save(
        rows.join(by_doc, ["doc", "h"]).select("doc", "h", "text", "shared").mapInArrow(_runs(window, anchor), "doc long, h long, pos array<int>, n array<int>, anchor array<long>, content array<long>, windows array<array<long>>"),
        "runs",
    )
    drop_saved(by_doc)
    each = runs.select("doc", "h", F.inline(F.arrays_zip("pos", "n", "anchor", "content", "windows")))
    # a run that stands whole in an earlier document is a factor
    firsts = save(each.groupBy("anchor", "content", "n").agg(F.min("doc").alias("first")), "contents")
    known = save(each.join(firsts, ["anchor", "content", "n"]).select("doc", "h", "pos", "n", "anchor", (F.col("first") < F.col("doc")).alias("whole"), F.when(F.col("first") == F.col("doc"), F.col("windows")).alias("windows")), "known-runs")
    drop_saved(runs)
    # the others are parsed where their anchor has other contents too
    blocks = save(firsts.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1"), "blocks")
    rest = known.where("NOT whole").select("doc", "h", "anchor", "pos", "windows")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rest.join(blocks.where(F.col("runs") <= block_runs).select("anchor"), "anchor").repartition(parts, "anchor").sortWithinPartitions("anchor")
    parsed = dealt.select("anchor", "doc", "h", "pos", "windows").mapInArrow(in_groups(["anchor"], _parsed), "doc long, h long, pos int, n int")
    large = rest.join(blocks.where(F.col("runs") > block_runs).select("anchor"), "anchor", "left_semi")
    windows = save(large.select("doc", "h", "anchor", "pos", F.posexplode("windows").alias("i", "window")).select("doc", "h", "anchor", "window", (F.col("pos") + F.col("i")).alias("pos")), "single-windows")
    least = windows.groupBy("anchor", "window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    singles = windows.join(save(least, "window-firsts"), ["anchor", "window"]).where("first < doc").select("doc", "h", "pos", F.lit(1).alias("n"))
    found = known.where("whole").select("doc", "h", "pos", "n").unionByName(parsed).unionByName(singles)
    return found.groupBy("doc", "h").agg(F.collect_set(F.struct(F.col("pos").alias("start"), "n")).alias("spans"))


def _cut(window: int, joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans")):
                words = (text or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid and len(words):
                    values = spans.values
                    start, n = values.field("start").to_numpy().astype(np.int64), values.field("n").to_numpy()
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + n + window - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                left = [w for w, g in zip(words, gone) if not g] if gone.any() else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            final = pa.array([x.decode() for x in kept]) if joined else pa.array([hashlib.sha256(x).hexdigest() for x in kept])
            names = [x for x in batch.schema.names if x != "spans" and (joined or x != "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), final], names=[*names, "n_words", "n_removed", "kept_text" if joined else "kept_sha256"])

    return run


def remove_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """docs with n_words, n_removed and kept_text (with digest: kept_sha256 in its place, and no text): each word covered by a
    window of 13 words that also starts in a document of a smaller id is gone; kept words are joined by one space.

    Words are runs of anything but space and tab to carriage return, unchanged. Windows are judged on the input.
    Null and empty texts have no words; texts shorter than a window lose none; the smallest id keeps all; rows of one
    id are one document and lose alike; a null id counts as the smallest. Other columns stay, those named like
    results are replaced."""
    base = docs.drop("n_words", "n_removed", "kept_text", "kept_sha256", "spans")
    spans = duplicate_spans(base.select("doc_id", "text"), window, anchor)
    keyed = base.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL))).withColumn("__h", F.xxhash64("text"))
    joined = keyed.join(spans.withColumnsRenamed({"doc": "__doc", "h": "__h"}), ["__doc", "__h"], "left").drop("__doc", "__h")
    schema = (base.drop("text") if digest else base).withColumn("n_words", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long")).withColumn("kept_sha256" if digest else "kept_text", F.lit("")).schema
    return joined.mapInArrow(_cut(window, not digest), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document. Texts end in the workers: the table is small, and it is
    written here, with save()'s small batches, not with the caller's."""
    return save(remove_spans(docs.select("doc_id", "text"), digest=True), "substring-digests")


DIGEST_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, p, hash(array_to_string(ws[p:p+12], ' ')) AS h, md5(array_to_string(ws[p:p+12], ' ')) AS m FROM s),
d AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h, m) AS f FROM g) WHERE f < doc_id),
c AS (SELECT DISTINCT doc_id, p + o AS i FROM d, (SELECT unnest(range(0, 13)) AS o)),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws
                              ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id)
"""
