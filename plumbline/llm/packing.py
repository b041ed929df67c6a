"""Packing documents into sequences: online best fit over a bounded number of open windows."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.common import save, slices

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [x.split()[0] for x in _PIECE.split(", ")]
_OPEN = _PIECE + ", fill long"


class Windows:
    """At most `most` open windows. put() places a group of pieces into the fullest window that holds it; when none
    does, a new one opens, and if that is one too many the fullest is emitted."""

    def __init__(self, room: int, most: int, emit):
        self.room, self.most, self.emit = room, most, emit
        self.fills: list[tuple[int, int]] = []  # (fill, window) in order
        self.pieces: dict[int, list] = {}
        self.opened = 0

    def put(self, length: int, pieces: list) -> None:
        at = bisect.bisect_right(self.fills, (self.room - length, 1 << 62)) - 1
        if at >= 0:
            fill, window = self.fills.pop(at)
        else:
            if len(self.fills) >= self.most:
                _, full = self.fills.pop()
                self.emit(self.pieces.pop(full))
            self.opened += 1
            fill, window = 0, self.opened
            self.pieces[window] = []
        held = self.pieces[window]
        held += pieces
        if fill + length >= self.room:
            self.emit(self.pieces.pop(window))
        else:
            bisect.insort(self.fills, (fill + length, window))


def _table(sequences: list[tuple[int, list]], fills: bool) -> pa.RecordBatch:
    """A row for each piece (doc_id, start, length, crc, doc_tokens) of each sequence."""
    rows = []
    for number, pieces in sequences:
        offset, fill = 0, sum(p[2] for p in pieces)
        for p in pieces:
            rows.append((*p, number, offset, fill) if fills else (*p, number, offset))
            offset += p[2]
    names = [*_FIELDS, "fill"] if fills else _FIELDS
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(names))], names=names)


def _merger(round_: int, room: int, open_windows: int | None):
    """Packs a group of leftover windows, each as a whole. open_windows None: the last round, nothing stays open."""

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        task = key[0].as_py()
        rows = group.sort_by([("sequence_id", "descending"), ("offset", "ascending")]).to_pydict()
        whole: dict[int, list] = {}
        for sequence, *piece in zip(rows["sequence_id"], *(rows[x] for x in _FIELDS[:5])):
            whole.setdefault(sequence, []).append(tuple(piece))
        done: list[tuple[int, list]] = []
        emit = lambda pieces: done.append((round_ << 56 | task << 32 | len(done), pieces))
        out = Windows(room, open_windows or len(whole) + 1, emit)
        for pieces in sorted(whole.values(), key=lambda x: -sum(p[2] for p in x)):  # all are known: longest first
            out.put(sum(p[2] for p in pieces), pieces)
        for _, w in out.fills:
            if open_windows is None:
                emit(out.pieces[w])
            else:
                done.append((-(task << 32 | w) - 1, out.pieces[w]))
        return pa.Table.from_batches([_table(done, True)])

    return merged


def pack(docs: DataFrame, vocabulary: str, pattern: str, room: int = 1024, open_windows: int = 64, merge: int = 16, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences of at most `room` tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its text's ids (null: none) and end_id, cut every `room` ids; each full cut is a sequence, the rest
    goes to the open windows of its partition. What is left open at a partition's end is merged: partitions send their
    leftover windows, as wholes, to one task for each `merge` of them, until one round holds them or nothing shrinks; a
    task never has more than merge * open_windows windows. Repeated rows and null doc_ids are packed like any other;
    other columns are not read; an empty table gives no rows. sequence_id is unique, not gapless: round, task, number."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = bpe.library_coder(vocabulary, pattern), np.dtype(bpe.library_type(vocabulary))
        task, number, done = TaskContext.get().partitionId(), 0, []

        def emit(pieces: list) -> None:
            nonlocal number
            number += 1
            done.append((task << 32 | number, pieces))

        windows = Windows(room, open_windows, emit)
        for batch in slices(batches, "text"):
            keys = batch.column("doc_id").to_pylist()
            for key, raw in zip(keys, coder([x or "" for x in batch.column("text").to_pylist()])):
                ids = np.append(np.frombuffer(raw, kind).astype("<u4"), np.uint32(end_id))
                for a in range(0, len(ids), room):
                    cut = ids[a : a + room]
                    piece = (key, a, len(cut), zlib.crc32(cut.tobytes()), len(ids))
                    if len(cut) == room:
                        emit([piece])
                    else:
                        windows.put(len(cut), [piece])
            yield _table(done, True)
            done.clear()
        # open windows are told by their negative numbers
        yield _table([(-(task << 32 | w) - 1, windows.pieces[w]) for _, w in windows.fills], True)

    placed = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, _OPEN), "packed")
    done, round_ = [placed.where("sequence_id >= 0")], 0
    while True:
        open_ = placed.where("sequence_id < 0")
        windows, tasks = open_.agg(F.count_distinct("sequence_id"), F.count_distinct(F.shiftright(-F.col("sequence_id") - 1, 32))).first()
        round_ += 1
        last = tasks <= merge
        if windows == 0:
            break
        group = F.shiftright(-F.col("sequence_id") - 1, 32) % max(1, -(-tasks // merge))

        placed = save(open_.withColumn("task", group).groupBy("task").applyInArrow(_merger(round_, room, None if last else open_windows), _OPEN), "merged")
        done.append(placed.where("sequence_id >= 0"))
        if last:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*_FIELDS)
