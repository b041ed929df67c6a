"""Line deduplication against levelled sorted runs of line keys. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import drop_bucketed, save, save_bucketed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRIPPED = " \t\n\x0b\x0c\r"
_NULL_FIRST = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_STRIPPED))
    # lower() is quick and right for ASCII; other letters must stay as they are
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


class Runs:
    """Sorted runs of (key, first): each key once over all runs, with the smallest document that holds it.

    add() takes a batch whose documents all come after those before, merge-anti-joins its keys to the runs and
    writes the new ones as a run of level 0; when a level has `fanout` runs they are compacted into one of the next. Runs are
    tables dealt into `buckets` by key and sorted in each, so that Spark merges them where they lie: only the batch is
    dealt out anew."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def all(self) -> list[DataFrame]:
        return [self.spark.table(run) for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        fresh = keys.groupBy("key").agg(F.min("doc").alias("first"))
        for run in self.all():
            fresh = fresh.join(run.select("key").hint("merge"), "key", "left_anti")
        self._put(fresh, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(save_bucketed(run, f"run{level}", "key", self.buckets))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            # the runs have no key in common
            self._put(reduce(DataFrame.unionByName, [self.spark.table(x) for x in old]).repartition(self.buckets, "key"), level + 1)
            for x in old:
                drop_bucketed(self.spark, x)

    def table(self) -> DataFrame:
        """All runs, as a plain table; the runs themselves are gone after this."""
        found = save(reduce(DataFrame.unionByName, self.all()), "runs")
        for level in self.levels:
            for x in level:
                drop_bucketed(self.spark, x)
        self.levels = []
        return found


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: of the lines whose key (see line_key) has at least min_chars code
    points and stands in several documents, only those of the smallest document id stay, all of them.

    Null and empty texts have one empty line. A null id is one document, before all others. Rows of one id are one
    document: their lines are judged alike and each row keeps its own text. Other columns stay; those named n_lines,
    n_dropped or kept_text are replaced. Documents come in `batches` of ascending ids (a number, not a size: the
    work is in proportion to the input), as a feed would bring them. Keys are 128-bit hashes; a row's lines are found
    again by its id and a 64-bit hash of its text, and by their places in it."""
    base = docs.drop("n_lines", "n_dropped", "kept_text")
    doc = F.coalesce(F.col(key).cast("long"), F.lit(_NULL_FIRST))
    edges = base.select(F.percentile_approx(doc, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = reduce(lambda a, e: a + F.when(doc > e, 1).otherwise(0), edges, F.lit(0))
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    lines = base.select(doc.alias("doc"), F.xxhash64(text).alias("h"), batch.alias("batch"), F.posexplode(parts).alias("pos", "line"))
    lines = lines.withColumn("line", line_key("line")).where(F.length("line") >= min_chars)
    # one row for each key and text, whatever the number of its lines
    keyed = lines.select("batch", "doc", "h", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"), "pos")
    keys = save(keyed.groupBy("batch", "doc", "h", "key").agg(F.collect_set("pos").alias("at")), "line-keys", "batch")
    runs = Runs(docs.sparkSession, fanout)
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i).drop("batch"))
    repeated = keys.join(runs.table(), "key").where(F.col("first") < F.col("doc"))
    drops = repeated.groupBy("doc", "h").agg(F.flatten(F.collect_list("at")).alias("__drops"))
    keyed_rows = base.withColumn("__doc", doc).withColumn("__h", F.xxhash64(text))
    out = keyed_rows.join(drops.withColumnsRenamed({"doc": "__doc", "h": "__h"}).hint("merge"), ["__doc", "__h"], "left").drop("__doc", "__h")
    out = out.withColumn("n_lines", F.size(parts).cast("long")).withColumn("n_dropped", F.coalesce(F.size("__drops"), F.lit(0)).cast("long"))
    # places that stay, by a hash set: in proportion to the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drops"))
    held = F.array_join(F.transform(stay, lambda i: F.element_at("__lines", i + 1)), "\n")
    whole = F.coalesce(F.col(text), F.lit(""))
    return out.withColumn("__lines", parts).withColumn("kept_text", F.when(F.col("__drops").isNull(), whole).otherwise(held)).drop("__drops", "__lines")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
         translate(trim(parts[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
firsts AS (SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.*, coalesce(f.first < l.doc_id, false) AS dropped FROM lines l LEFT JOIN firsts f USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
