"""Binary files as rows (arrays, archives, folders), canonical JSON, product names, and rows gathered by number."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterable, Iterator
from itertools import batched
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import custody

#: Values in one batch of an array, bytes in one of contents, and members in one of archives on their way out of a task.
_BATCH = 65_536
_BYTES = 8 << 20
_MEMBERS = 16_384


def in_bytes(made: Iterable[tuple[str, bytes]], most: int = _BYTES) -> Iterator[pa.RecordBatch]:
    """Pairs of path and content as batches that end once they hold `most` bytes of contents, so that a task holds a few
    contents, however large they are."""

    def batch(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        paths, contents = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    held: list[tuple[str, bytes]] = []
    size = 0
    for pair in made:
        held.append(pair)
        size += len(pair[1])
        if size >= most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def array_values(files: DataFrame) -> DataFrame:
    """path, name, i, value: the numbers of .npy and .npz files (rows: path, content, as of Spark's binaryFile), flat in C
    order; name is null in an .npy. Null or empty contents give no rows; arrays of other kinds than numbers and
    truth values raise, pickles too. A file is one row, so at most 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if not content.is_valid or not len(content.as_py()):
                    continue
                held = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                for name in [None] if isinstance(held, np.ndarray) else held.files:
                    values = (held if name is None else held[name]).ravel()
                    if values.dtype.kind not in "biuf":
                        raise TypeError(f"{path}: {name} holds no numbers but {values.dtype}")
                    for a in range(0, len(values), _BATCH):
                        part = values[a : a + _BATCH].astype(float)
                        columns = [pa.array([path] * len(part), pa.string()), pa.array([name] * len(part), pa.string()), pa.array(np.arange(a, a + len(part))), pa.array(part)]
                        yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "i", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, i long, value double")


def archive_members(files: DataFrame) -> DataFrame:
    """path, place, member, byte_count of the files in tar archives, compressed or not (rows: path, content), folders and
    links left out. Null contents give no rows; what is no archive raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        for batch in batches:
            for rows in batched(members(batch), _MEMBERS):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["path", "place", "member", "byte_count"])

    def members(batch: pa.RecordBatch) -> Iterator[tuple[str, int, str, int]]:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            if content.is_valid:
                with tarfile.open(fileobj=pa.BufferReader(content.as_buffer())) as archive:
                    yield from ((path, i, m.name, m.size) for i, m in enumerate(x for x in archive if x.isfile()))

    return files.select("path", "content").mapInArrow(run, "path string, place int, member string, byte_count long")


def tree_manifest(spark: SparkSession, folder: str, leave_out: tuple[str, ...] = ("manifest.json",)) -> DataFrame:
    """path (below the folder), byte_count and sha256 of every file under it but those of the names left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    root = urlparse(folder).path.rstrip("/") + "/"
    below = F.substring("path", F.instr("path", root) + len(root), F.length("path"))
    rows = found.select(below.alias("path"), "content").where(~F.element_at(F.split("path", "/"), -1).isin(*leave_out))
    return custody.manifest(rows, "path", "content")


def _ordered(c: Column, kind: T.DataType) -> Column:
    """c with the fields of its structs by name, at every depth."""
    if isinstance(kind, T.StructType):
        made = F.struct(*[_ordered(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    return c


def canonical_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One column: each row of df as JSON with its keys sorted at every depth and nulls written, so that equal rows have equal
    texts. Maps keep their own order."""
    row = F.struct(*[_ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(out))


def product_path(base: str, day: Column, kind: str) -> Column:
    """Where the clock (hr.tdp) or the position product (pos) of a day lies."""
    if kind not in ("hr.tdp", "pos"):
        raise ValueError(f"unknown kind {kind}")
    ending = {"hr.tdp": "_hr.tdp.gz", "pos": ".pos.gz"}[kind]
    return F.concat(F.lit(base.rstrip("/") + "/"), F.year(day).cast("string"), F.lit("/"), F.date_format(day, "yyyy-MM-dd"), F.lit(ending))


def gather(wanted: DataFrame, values: DataFrame, place: str = "place", row: str = "row_id") -> DataFrame:
    """The rows of values at the row numbers asked for, each with its place in the request; a number may be asked for
    again. Numbers that are null or not there give no rows. Only columns that are selected later are read."""
    return wanted.select(place, row).join(values, row)


def select_allowed(df: DataFrame, columns: list[str], allowed: dict[str, list[str]], stage: str) -> DataFrame:
    """The columns of df that a stage asks for; one that it may not read is an error before anything is planned, so that the
    values of a holdout are never read in discovery."""
    refused = [c for c in columns if c not in allowed.get(stage, [])]
    if refused:
        raise PermissionError(f"stage {stage} may not read {refused}")
    return df.select(*columns)


def write_csv(df: DataFrame, folder: str) -> DataFrame:
    """Writes df as CSV with a header into a folder of any store Spark writes to, and gives path, byte_count and sha256 of each file:
    the record that a manifest keeps. As many files as df has partitions."""
    df.write.option("header", "true").mode("errorifexists").csv(folder)
    return tree_manifest(df.sparkSession, folder, ("_SUCCESS",))


def document(df: DataFrame) -> str:
    """A table of one row as a JSON text of two-space indents, keys sorted at every depth, and a final line feed: equal rows have
    equal bytes."""
    (row,) = canonical_json(df).limit(2).collect()
    return json.dumps(json.loads(row[0]), indent=2, sort_keys=True, ensure_ascii=False) + "\n"
