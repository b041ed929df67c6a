"""Quality classifier: linear support vectors on n-gram indicators scaled by Naive Bayes log-count ratios."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keeps, lists, save, slices

#: N-grams are hashed to so many indicators.
BUCKETS = 1 << 20
#: Bytes of text whose indicators are made at once: the arrays on the way take some hundred times as much.
_AT_ONCE = 1 << 18
_SHAPE = re.compile(r"[^\W\d_]+|\d+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> str:
    """The word's letters as one case mark, digits as one, other characters as they are."""
    case = lambda m: "9" if m[0][0].isdigit() else "A" if m[0].isupper() and len(m[0]) > 1 else "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a"
    return _SHAPE.sub(case, word)


class Grams:
    """The n-gram indicators of texts: words (1 and 2), word shapes (1 to 3), and whether a word repeats one of the two
    before it (runs of 1 to 3 such marks)."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}  # the word's hash above its shape's
        self.most = most

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and bucket numbers, each pair once, in order."""
        words = [x.split() for x in texts]
        if len(self.known) > self.most:
            self.known = {}
        for w in set().union(*words).difference(self.known):
            self.known[w] = zlib.crc32(w.lower().encode()) << 32 | zlib.crc32(_shape(w).encode())
        row = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        if not len(row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.fromiter((self.known[w] for part in words for w in part), np.uint64, len(row))
        word, shape = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF) | np.uint64(1 << 32)
        one, two = np.zeros(len(row), bool), np.zeros(len(row), bool)
        one[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        two[2:] = (word[2:] == word[:-2]) & (row[2:] == row[:-2])
        again = one.astype(np.uint64) + np.uint64(2) * two.astype(np.uint64) + np.uint64(1 << 33)
        keys = [(row, word), (row, shape), (row, again)]
        for base, orders in ((word, (2,)), (shape, (2, 3)), (again, (2, 3))):
            for n in orders:
                if len(row) >= n:
                    same = row[n - 1 :] == row[: len(row) - n + 1]
                    gram = base[: len(row) - n + 1].copy()
                    for k in range(1, n):
                        gram = gram * _MIX + base[k : len(row) - n + 1 + k]
                    keys.append((row[n - 1 :][same], (gram * _MIX + np.uint64(n))[same]))
        rows = np.concatenate([r for r, _ in keys]).astype(np.int64)
        mixed = np.concatenate([k for _, k in keys])
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
        pairs = np.unique(rows * BUCKETS + (mixed >> np.uint64(44)).astype(np.int64))
        return pairs // BUCKETS, pairs % BUCKETS


_grams = Grams()


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * (weights . indicators / sqrt(their number) + bias) + offset)))."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        n = np.maximum(np.bincount(row, minlength=rows), 1)
        return np.bincount(row, self.weights[bucket], minlength=rows) / np.sqrt(n) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -35, 35)))


def fit_rows(features: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Log-count ratios of the indicators by class, then dual coordinate descent for the hinge loss on the
    indicators times their ratios (rows scaled to length one over the number of indicators). Returns one weight
    for each bucket, ratio included, and the bias."""
    counts = np.full((2, BUCKETS), alpha)
    for x, y in zip(features, labels):
        counts[int(y)][x] += 1
    seen = (counts.sum(0) > 2 * alpha).nonzero()[0]
    share = counts[:, seen] / (np.bincount(labels, minlength=2)[:, None] + 2 * alpha)
    ratio = np.zeros(BUCKETS)
    ratio[seen] = np.log(share[1] / share[0])
    w, bias = np.zeros(BUCKETS), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    most = c * len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))[labels]  # classes weigh the same
    dual, order = np.zeros(len(labels)), np.random.default_rng(seed)
    value = lambda x: ratio[x] / np.sqrt(max(len(x), 1))
    norm = np.array([np.square(value(x)).sum() + 1 for x in features])
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(labels)):
            x, v = features[i], value(features[i])
            slope = sign[i] * (w[x] @ v + bias) - 1
            new = min(max(dual[i] - slope / norm[i], 0.0), most[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[x] += step * v
                bias += step
                moved, dual[i] = max(moved, abs(step)), new
        if moved < 1e-4:
            break
    return (w * ratio).astype(np.float32), bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Newton steps, smoothed targets)."""
    up, down = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, h = p - target, p * (1 - p) + 1e-9
        g = np.array([d @ margins + 1e-3 * a, d.sum()])
        m = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum()]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _features(df: DataFrame, text: str) -> DataFrame:
    """label, h, t, the sorted indicators of each row, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("indicators")
        for batch in slices(batches, "text", _AT_ONCE):
            row, bucket = _grams([x or "" for x in batch.column("text").to_pylist()])
            cuts = np.searchsorted(row, np.arange(1, batch.num_rows))
            found = np.split(bucket, cuts)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("label", "h", "t")), lists(found, pa.int32()), pa.array([len(x) for x in found], pa.int64())], names=["label", "h", "t", "grams", "n"])

    return df.select(F.col(text).alias("text"), "label", "h", "t").mapInArrow(run, "label int, h long, t long, grams array<int>, n long")


def _least(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, those of smallest (h, t); of rows alike in both any may be the last. Two numbers a row are
    compared, without texts."""
    place = F.struct("h", "t")
    few = rows.select("h", "t").orderBy("h", "t").limit(most).groupBy("h", "t").agg(F.count("*").alias("n"))
    edge = few.agg(F.max(place).alias("e"), F.max_by("n", place).alias("n")).first()
    if edge["e"] is None:
        return rows.limit(0)
    last = F.struct(F.lit(edge["e"]["h"]).alias("h"), F.lit(edge["e"]["t"]).alias("t"))
    # a limit goes through one task: only rows alike with the last one do
    return rows.where(place < last).unionByName(rows.where(place == last).limit(edge["n"]))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", max_rows: int = 12_000, c: float = 1.0, max_grams: int = 24_000_000) -> Model:
    """A model from labelled rows (label 0 or 1; other labels and null keys are left out; repeated rows each count).

    max_rows and max_grams bound the training sample, and with it what the driver gets: the rows of smallest hashes of
    key and text, max_rows of them at most and no more than have max_grams indicators together (a row has 2^20 at
    most). Counts, support vectors and calibration (on every fifth row, out of fold) come from the sample.
    With one class or no rows, the score is that class's smoothed share everywhere."""
    rows = labelled.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(F.lit(17), key).alias("h"), F.xxhash64(text).alias("t"))
    made = save(_features(_least(rows, max_rows), "text"), "training-sample")
    # in the order of the hashes, as many rows as max_grams allows; up to max_rows rows of three numbers
    places = sorted((r.h, r.t, r.n) for r in made.select("h", "t", "n").collect())
    kept = int(np.searchsorted(np.cumsum([n for _, _, n in places]), max_grams, "right"))
    got = (made if kept == len(places) else _least(made, kept)).select("label", "grams").toArrow()
    labels = got["label"].to_numpy().astype(int)
    grams = got["grams"].combine_chunks()
    flat, cuts = grams.flatten().to_numpy(), np.cumsum(np.append(0, pc.list_value_length(grams).to_numpy()))
    features = [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]  # views: the sample is held once
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    # order by content: the tasks' order does not matter
    order = sorted(range(len(labels)), key=lambda i: (labels[i], hashlib.md5(features[i]).digest()))
    features, labels = [features[i] for i in order], labels[order]
    fold = np.arange(len(labels)) % 5 == 0
    part = lambda pick: ([features[i] for i in np.flatnonzero(pick)], labels[pick])
    model = Model(*fit_rows(*part(~fold), c=c), 1.0, 0.0)
    held, y = part(fold)
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    slope, offset = calibrate(model.margins(row, np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64), len(held)), y)
    return Model(model.weights, model.bias, slope, offset)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with a score from 0 to 1 for each whole text (null or empty: of no indicators). No shuffle; other columns
    stay, one named as `out` is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input
    kept = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("indicators")
        for batch in slices(batches, text, _AT_ONCE):
            row, bucket = _grams([x or "" for x in batch.column(text).to_pylist()])
            found = shared.value.scores(shared.value.margins(row, bucket, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, kept.withColumn(out, F.lit(0.0)).schema)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def train_on(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Model:
    """A model from the documents whose labels.quality is known and that are not held out. Of several labels of one
    document the smallest counts; of several rows of one document each is learned."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"))
    marks = marks.where(~held_out()).select("doc_id", "label", F.xxhash64(F.lit(17), "doc_id").alias("h"))
    few = _least(marks.withColumn("t", F.col("h")), max_rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(few.drop("h", "t")), "doc_id"), max_rows=max_rows)  # at most max_rows pairs of numbers


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, repeated ones too. A null doc_id counts as not held
    out and is never learned from; null and empty texts are scored; an empty table gives no rows. Other columns, one named
    score among them, are not read."""
    out = score(docs.select("doc_id", "text"), train_on(docs, labels, max_rows))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
