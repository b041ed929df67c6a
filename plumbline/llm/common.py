"""Tables, the shared folder, and arrays in and out of Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import shared_dir

#: White space that parts words and is stripped from lines.
SPACE = r"[\x20\x09-\x0D]"
#: Batches of rows on their way to Python are small, as texts are long: an executor holds a batch several times, on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "1m"}
#: While a table is written: its shuffle files go when it ends, not at the driver's next GC, batches are small, and sorted
#: buckets are read as sorted.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **BATCHES, "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
#: What this worker keeps from task to task, each with the call that lets it go.
_kept: dict[str, Callable[[], object]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, tag: str, *partition_by: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _writing(spark):
        writer = df.write.options(**options)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> str:
    """df as a table in the shared folder, dealt into buckets by key and sorted by it in each; the table's name."""
    name = f"{tag}_{uuid.uuid4().hex}"
    with _writing(df.sparkSession):
        df.write.format("parquet").option("path", f"{shared_dir(df.sparkSession)}/{name}").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return name


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Takes a table of save_bucketed() out of the catalog and deletes its files."""
    drop_saved(spark.table(name))
    spark.sql(f"DROP TABLE {name}")


def drop_saved(df: DataFrame) -> None:
    """Deletes a table that save() made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        head, _, rest = file.partition(shared_dir(spark).removeprefix("file://").rstrip("/") + "/")
        if rest:
            path = jvm.org.apache.hadoop.fs.Path(file[: len(file) - len(rest)] + rest.split("/")[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with the number (from 1) of each row in an order of all rows. The order is cut into sampled ranges, which are written once; a
    row for each range carries the count of those before."""
    ranges = save(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn(out, inside).join(F.broadcast(before), "__range").withColumn(out, F.col("__before") + F.col(out)).drop("__range", "__before")


def give_back() -> None:
    """What a task's batches took and freed goes back to the system, where the C library can: a worker that waits for its next task stands beside
    the heap of a stage that may have no Python in it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keeps(what: str, forget: Callable[[], object] = bool) -> None:
    """From here on this worker keeps `what`, until forget() is called. A worker goes from one operator's tasks to the next one's, so whatever
    else it kept goes now."""
    if what in _kept and len(_kept) == 1:
        return
    for other in [x for x in _kept if x != what]:
        _kept.pop(other)()
    _kept[what] = forget
    give_back()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `most` bytes of a column (one row at least), so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        part = (np.cumsum(at) - 1) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
    give_back()


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One Arrow list for each array."""
    ends = np.cumsum([0, *(len(x) for x in arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def in_groups(keys: list[str], use: Callable[[pa.Table], pa.RecordBatch | None]):
    """For mapInArrow over rows sorted by keys: use() gets whole groups, several at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple = ()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = use(pa.Table.from_batches(held).combine_chunks())
                if found is not None:
                    yield found

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for x in ids:
                change[1:] |= x[1:] != x[:-1]
            if held and tuple(x[0] for x in ids) != last:
                yield from flush()
                held = []
            cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
            if cut:
                held.append(batch.slice(0, cut))
                yield from flush()
                held = []
            held.append(batch.slice(cut))
            last = tuple(x[-1] for x in ids)
        yield from flush()
        held = []
        give_back()

    return run
