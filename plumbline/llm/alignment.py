"""Cross-tokenizer alignment: token byte ranges of two vocabularies, and how often their ids end together in a corpus.

Pairs of ids are packed into int64 keys, the second vocabulary's id high. Tasks count their own keys with np.unique; the partial
counts are sorted over range partitions and runs of one key summed, which leaves sorted shards: a file of keys and a file of counts
each, in the shared folder. Lookups map these into memory and search them."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.common import save, slices
from plumbline.session import shared_dir

#: Distinct keys that a task holds before it sends their counts on.
HELD_KEYS = 1 << 20
#: Chunks that a worker has aligned and holds.
CACHED = 120_000
_LOW = (1 << 32) - 1


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary of the tokenizers library."""
    from tokenizers import Tokenizer

    to_bytes = {ord(c): b for b, c in enumerate(bpe.byte_chars())}
    model = Tokenizer.from_file(path)
    special = model.get_added_tokens_decoder()
    return [b"" if i in special else model.id_to_token(i).translate(to_bytes).encode("latin-1") for i in range(model.get_vocab_size())]


def piece_tokens(model) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model: U+2581 as a space, <0xHH> as a byte, control pieces as none."""
    none = lambda i: model.is_control(i) or model.is_unknown(i)
    return [b"" if none(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]


def parts_at_spaces(pieces: list[str]) -> bool:
    """Whether no piece reaches from anything else into a space or a line end."""
    return not any(y in "▁\n" and x not in "▁\n" for p in pieces for x, y in zip(p, p[1:]))


class Aligner:
    """Both vocabularies in a worker. The first is byte-level; no pre-token of its pattern may reach from a character into a space after it.

    Texts are cut into chunks, before spaces and line ends that follow other characters. Where the second vocabulary's pieces do not reach
    across and its model takes texts as they are, chunks are encoded and aligned by themselves, each distinct one once for as long as the
    cache holds it; otherwise a text is one chunk. A space goes before each text, so the second model's copy puts none of its own."""

    def __init__(self, path_a: str, path_b: str, cached: int = CACHED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.model_a, whole = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.model_a.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
        self.bytes_a, self.bytes_b = byte_tokens(path_a), piece_tokens(whole)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        probe = "a  b \n ﬁ① Å\t "
        if parts_at_spaces([whole.id_to_piece(i) for i in range(len(self.bytes_b))]) and whole.normalize(probe) == ("▁" + probe).replace(" ", "▁"):
            with open(path_b, "rb") as f:  # a field that is set again takes the place of the first: add_dummy_prefix of the normaliser
                bare = sentencepiece.SentencePieceProcessor(model_proto=f.read() + bpe.field(3, bpe.flag(3, 0)))
            self.encode_b = lambda chunks: bare.encode(chunks, out_type=int, num_threads=1)
            self.chunks = re.compile(r"\s*\S+(?:(?![ \n])\s+\S*)*|\s+").findall
        else:
            self.encode_b = lambda chunks: whole.encode([x[1:] for x in chunks], out_type=int, num_threads=1)
            self.chunks = lambda text: [text]
        self.most, self.known = cached, {}

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, bytes, bytes]]:
        """The numbers of tokens, the links (packed int64, in order) and the groups spelt out, of each text; nothing of a text
        that is null or empty, or that joined tokens of either vocabulary do not give back after a space."""
        parts = [self.chunks(f" {x}") if x else [] for x in texts]
        if len(self.known) > self.most:  # the oldest half holds the common chunks
            self.known = dict(itertools.islice(self.known.items(), self.most // 2))
        new = list(set().union(*parts).difference(self.known))
        self.known.update(zip(new, self._aligned(new)))
        out = []
        for part in parts:
            own = list(zip(*map(self.known.__getitem__, part)))
            out.append((sum(own[0]), sum(own[1]), b"".join(own[2]), b";".join(own[3])) if own and all(own[3]) else (0, 0, b"", b""))
        for chunk in new:
            if len(chunk) > bpe.CACHED_CHARS:
                del self.known[chunk]
        return out

    def _encoded_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each chunk has. Chunks begin with white space; those that end with none are one input together, as
        no pre-token reaches across their ends."""
        alone = [i for i, x in enumerate(chunks) if x[-1].isspace()]
        rest = sorted(set(range(len(chunks))).difference(alone)) if alone else range(len(chunks))
        found = self.model_a.encode_batch_fast(["".join(chunks[i] for i in rest), *(chunks[i] for i in alone)], add_special_tokens=False)
        ids = np.array(found[0].ids, np.int64)
        ends = np.cumsum([len(chunks[i].encode()) for i in rest])
        n = np.zeros(len(chunks), np.int64)
        n[list(rest)] = np.diff(np.searchsorted(np.cumsum(self.size_a[ids]), ends, "right"), prepend=0)
        for i, x in zip(alone, found[1:]):
            n[i] = len(x.ids)
        if alone:
            flat = np.empty(int(n.sum()), np.int64)
            mark = np.repeat(np.isin(np.arange(len(chunks)), alone), n)
            flat[~mark], flat[mark] = ids, np.concatenate([x.ids for x in found[1:]])
            ids = flat
        return ids, n

    def _aligned(self, chunks: list[str]) -> Iterator[tuple[int, int, bytes, bytes]]:
        for i in range(0, len(chunks), 4096):
            own = chunks[i : i + 4096]
            a, n_a = self._encoded_a(own)
            b = self.encode_b(own)
            n_b = np.array(list(map(len, b)), np.int64)
            b = np.array(list(itertools.chain.from_iterable(b)), np.int64)
            a, n_a, b, n_b = self._given_back(own, a, n_a, b, n_b)
            links, n, groups = self.align(a, n_a, b, n_b)
            raw, cuts = links.tobytes(), np.cumsum([0, *(8 * n)]).tolist()
            yield from zip(n_a.tolist(), n_b.tolist(), (raw[i:j] for i, j in zip(cuts, cuts[1:])), groups)

    def _given_back(self, chunks: list[str], *ids: np.ndarray) -> list[np.ndarray]:
        """a, n_a, b, n_b without the ids of chunks that joined tokens of either vocabulary do not give back."""
        raw = [x.encode() for x in chunks]
        cuts = np.cumsum([0, *map(len, raw)])
        whole = np.frombuffer(b"".join(raw), np.uint8)
        ok = np.ones(len(chunks), bool)
        for x, n, tokens, size in ((ids[0], ids[1], self.bytes_a, self.size_a), (ids[2], ids[3], self.bytes_b, self.size_b)):
            held = np.add.reduceat(np.append(size[x], 0), np.cumsum([0, *n[:-1]])) * (n > 0)
            joined = np.frombuffer(b"".join(map(tokens.__getitem__, x.tolist())), np.uint8)
            if len(joined) == len(whole) and (held == np.diff(cuts)).all():
                wrong = np.concatenate([[0], np.cumsum(joined != whole)])[cuts]
                ok &= np.diff(wrong) == 0
            else:
                own = np.split(joined, np.cumsum(held)[:-1])
                ok &= np.array([x.tobytes() == r for x, r in zip(own, raw)])
        if ok.all():
            return list(ids)
        return [ids[0][np.repeat(ok, ids[1])], ids[1] * ok, ids[2][np.repeat(ok, ids[3])], ids[3] * ok]

    def align(self, flat_a: np.ndarray, n_a: np.ndarray, flat_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The packed links of all texts in order, how many each has, and the groups of each spelt out.

        Texts stand one after another in both byte sequences and are of equal length in both, so offsets of all of them are
        compared at once. Tokens have bytes, so each common end is one link and one group."""
        starts_a, starts_b = np.cumsum([0, *n_a]), np.cumsum([0, *n_b])
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        ends = np.zeros((2, int(end_a[-1]) + 1 if len(end_a) else 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        both = ends.all(0)
        closes_a, closes_b = both[end_a], both[end_b]
        last_a, last_b = np.flatnonzero(closes_a), np.flatnonzero(closes_b)
        links = flat_b[last_b] << 32 | flat_a[last_a]
        # a group's tokens: those of a, then those of b; each token is its digits and what parts it from the next
        n, m = len(flat_a), len(flat_b)
        place_a = np.arange(n) + np.concatenate([[0], last_b + 1])[np.cumsum(closes_a) - closes_a]
        place_b = np.arange(m) + (last_a + 1)[np.cumsum(closes_b) - closes_b]
        part_b = np.where(closes_b, ord(";"), ord(",")).astype(np.uint8)
        part_b[starts_b[1:][np.diff(starts_b) > 0] - 1] = 0  # none at the end of a text
        ids, parts = np.empty(n + m, np.int64), np.empty(n + m, np.uint8)
        ids[place_a], ids[place_b], parts[place_a], parts[place_b] = flat_a, flat_b, np.where(closes_a, ord("|"), ord(",")), part_b
        table = _digits(max(len(self.size_a), len(self.size_b)))
        cells = np.concatenate([table[ids], parts[:, None]], 1)
        used = cells != 0
        spelt = cells[used].tobytes()
        cuts = np.concatenate([[0], np.cumsum(used.sum(1))])[starts_a + starts_b].tolist()
        return links, np.diff(np.searchsorted(last_b, starts_b)), [spelt[i:j] for i, j in zip(cuts, cuts[1:])]


@functools.cache
def _digits(most: int) -> np.ndarray:
    """The decimal digits of 0 to most - 1, then zero bytes."""
    spelt = np.arange(most).astype("S")
    return spelt.view(np.uint8).reshape(most, -1)


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 ('' without tokens) and links (binary: int64 keys in order) of every row of docs.

    Null and empty texts, and texts that either vocabulary does not give back byte by byte, have no tokens. A null key stays
    null; repeated rows are aligned alike; a whole text is aligned at once, however long; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in slices(batches, "text"):
            n_a, n_b, links, groups = zip(*both(batch.column("text").to_pylist()))
            n = [pa.array(x, pa.int64()) for x in (n_a, n_b, [len(x) // 8 for x in links])]
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in groups]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array(digests, pa.string()), pa.array(links, pa.binary())], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def partial_counts(found: DataFrame, held: int = HELD_KEYS) -> DataFrame:
    """key and n of each task's links; a task that holds too many keys sends what it has and begins anew."""

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate(counts))
        return distinct, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in slices(batches, "links", 8 << 20):
            own, n = np.unique(np.frombuffer(b"".join(x.as_py() for x in batch.column("links")), np.int64), return_counts=True)
            keys.append(own)
            counts.append(n)
            if sum(map(len, keys)) > held:
                distinct, total = merged(keys, counts)
                keys, counts = [distinct], [total]
                if 2 * len(distinct) > held:
                    yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(total)], names=["key", "n"])
                    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        distinct, total = merged(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(total)], names=["key", "n"])

    return found.select("links").mapInArrow(run, "key long, n long")


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def count_shards(found: DataFrame) -> tuple[str, DataFrame]:
    """The folder of sorted count shards, and their list: shard, low and high (keys), n, and best (struct of b and n: the highest count
    of each of the second vocabulary's ids in the shard).

    A shard is written under a name of its attempt and moved when whole, so that a task that runs again leaves the same
    files."""
    folder = f"{shared_dir(found.sparkSession)}/pair-counts-{uuid.uuid4().hex}"
    partial = save(partial_counts(found), "partial-counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path)
        shard, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        low, high, rows = None, None, 0
        best: dict[int, int] = {}
        with contextlib.ExitStack() as files:
            out = [files.enter_context(store.open_output_stream(f"{path}/{mark}.{x}")) for x in ("keys", "counts")]

            def put(keys: np.ndarray, n: np.ndarray) -> None:
                nonlocal low, high, rows
                if not len(keys):
                    return
                low, high, rows = int(keys[0]) if low is None else low, int(keys[-1]), rows + len(keys)
                b = keys >> 32
                first = np.flatnonzero(np.diff(b, prepend=-1))
                for x, most in zip(b[first].tolist(), np.maximum.reduceat(n, first).tolist()):
                    best[x] = max(best.get(x, 0), most)
                out[0].write(keys.astype("<i8").tobytes())
                out[1].write(n.astype("<i8").tobytes())

            key, sum_ = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last run, which may go on
            for batch in batches:
                keys = np.concatenate([key, batch.column("key").to_numpy()])
                n = np.concatenate([sum_, batch.column("n").to_numpy()])
                if not len(keys):
                    continue
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, n = keys[first], np.add.reduceat(n, first)
                put(keys[:-1], n[:-1])
                key, sum_ = keys[-1:], n[-1:]
            put(key, sum_)
        if rows:
            for x in ("keys", "counts"):
                store.move(f"{path}/{mark}.{x}", f"{path}/{shard}.{x}")
            rest = pa.array([[{"b": b, "n": n} for b, n in best.items()]], pa.list_(pa.struct([("b", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([low]), pa.array([high]), pa.array([rows]), rest], names=["shard", "low", "high", "n", "best"])
        else:
            for x in ("keys", "counts"):
                store.delete_file(f"{path}/{mark}.{x}")

    ordered = partial.repartitionByRange("key").sortWithinPartitions("key")
    return folder, save(ordered.mapInArrow(run, "shard int, low long, high long, n long, best array<struct<b:long,n:long>>"), "count-shards")


class Counts:
    """Lookups in count shards. Where the shared folder is a mounted one, files are mapped into memory in place and pages are
    read as they are wanted; from another store that pyarrow reaches, a worker reads them once."""

    def __init__(self, folder: str, shards: list[int], lows: list[int]):
        self.lows = np.array(lows, np.int64)
        store, path = _store(folder)
        if isinstance(store, pa.fs.LocalFileSystem):
            self.files = [[np.memmap(f"{path}/{s}.{x}", "<i8", "r") for x in ("keys", "counts")] for s in shards]
        else:
            self.files = [[np.frombuffer(store.open_input_file(f"{path}/{s}.{x}").read(), "<i8") for x in ("keys", "counts")] for s in shards]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys in ascending order; 0 where there is none."""
        out = np.zeros(len(keys), np.int64)
        cuts = [0, *np.searchsorted(keys, self.lows[1:]).tolist(), len(keys)]
        for (held, n), i, j in zip(self.files, cuts, cuts[1:]):
            if j > i:
                at = np.minimum(np.searchsorted(held, keys[i:j]), len(held) - 1)
                out[i:j] = np.where(held[at] == keys[i:j], n[at], 0)
        return out


@functools.lru_cache(1)
def _counts(folder: str, shards: tuple[int, ...], lows: tuple[int, ...]) -> Counts:
    return Counts(folder, shards, lows)


def with_counts(found: DataFrame, folder: str, shards: DataFrame) -> DataFrame:
    """found (of aligned()) with n_links, n_best and count_sum in place of links.

    What goes to the workers is a row for each shard, and the best count of each id of the second vocabulary, which is
    as many numbers as it has ids at most."""
    spark: SparkSession = found.sparkSession
    listed = shards.select("shard", "low").orderBy("low").collect()
    names, lows = tuple(r.shard for r in listed), tuple(r.low for r in listed)
    most = shards.select(F.inline("best")).groupBy("b").agg(F.max("n").alias("n")).collect()
    best = np.zeros(max((r.b for r in most), default=0) + 1, np.int64)
    for r in most:
        best[r.b] = r.n
    sent = spark.sparkContext.broadcast(best)
    kept = found.drop("links")
    schema = kept.withColumns({c: F.lit(0).cast("long") for c in ("n_links", "n_best", "count_sum")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(folder, names, lows)
        for batch in slices(batches, "links", 8 << 20):
            raw = [x.as_py() for x in batch.column("links")]
            starts = np.cumsum([0, *map(len, raw)]) // 8
            links, place = np.unique(np.frombuffer(b"".join(raw), np.int64), return_inverse=True)
            n = counts.of(links) if len(links) else links
            per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[place])])[starts])
            rest = [c for c in batch.schema.names if c != "links"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, (np.diff(starts), per((n == sent.value[links >> 32]).astype(np.int64)), per(n)))], names=[*rest, "n_links", "n_best", "count_sum"])

    return found.mapInArrow(run, schema)


def pair_counts(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """a, b and n of all shards, for use beside the lookups: a task reads a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("shard").to_pylist():
                keys, n = Counts(folder, [s], [0]).files[0]
                for i in range(0, len(keys), 1 << 16):
                    own = np.asarray(keys[i : i + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(own & _LOW), pa.array(own >> 32), pa.array(np.asarray(n[i : i + (1 << 16)]))], names=["a", "b", "n"])

    return shards.select("shard").mapInArrow(run, "a long, b long, n long")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (see aligned()).

    A link is a token of each vocabulary whose byte ranges end together; its count is how many links of all documents hold its pair of ids; it is
    best where no other pair of its second id has a higher one. Texts are encoded once; links are written beside the results and
    read for counting and for the lookup."""
    found = save(aligned(docs, path_a, path_b), "aligned", compression="zstd")
    folder, shards = count_shards(found)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return with_counts(found, folder, shards).select(*columns)
