"""N-gram Jaccard join by chosen paths.

Each text is its set of five-word shingles; equal sets are one class from the start. A class has a signature of T
minimum hashes. Trees are grown from the nodes (position, hash there): a node samples positions of the
signature, each with probability 1 / (threshold * T), and sends a class to the child (node, position, hash there).
Small nodes are compared by brute force. In larger ones all members meet a few pivots; a node whose members are nearly all
alike through one pivot is done, others split again, and what is still large at the last level is compared in pairs of
blocks. The first level's nodes stand at fixed positions; they are drawn until two classes at the threshold,
by the law of their signatures and a Galton-Watson recurrence at the last level, meet nowhere with probability below
1 - recall. What meets and is alike by signature forms provisional components, in which all pairs, in blocks, are
then judged by exact Jaccard."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop_saved, in_groups, save, slices
from plumbline.llm.components import components
from plumbline.llm.grams import RunHash, mixed, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
T = 128
LEAF = 1024
DEPTH = 5
RECALL = 0.9999
BLOCK = 256
#: Members of a large node that all its others meet.
PIVOTS = 4
#: Members of a large node that are looked at together with its pivots.
CHUNK = 128
_NULL = -(1 << 63)
_RNG = np.random.default_rng(20_24)
_A = _RNG.integers(0, 1 << 63, T, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, T, np.uint64)


def least_alike(threshold: float) -> int:
    """Equal positions that alike signatures have at least: below the threshold by more than five standard deviations of
    a signature's estimate."""
    return int(T * threshold - 5.5 * math.sqrt(T * threshold * (1 - threshold)))


def missed(roots: int, threshold: float = THRESHOLD, depth: int = DEPTH) -> float:
    """The probability that a pair at the threshold meets in no leaf of trees from so many roots, all leaves at this
    depth. Roots take the positions in turn, so a position has `each` of them or one more.

    Of a pair's k equal positions, each is drawn at a node with probability 1 / (threshold * T); a root where the pair
    is equal loses it with q_0 = 0, q_(d+1) = (1 - (1 - q_d) / (threshold * T))^k. k, one for all roots, is binomial, and
    the roots beyond `each` for every position are hypergeometric among the equal positions."""
    each, more = divmod(roots, T)
    total = 0.0
    for k in range(T + 1):
        weight = math.comb(T, k) * threshold**k * (1 - threshold) ** (T - k)
        lost = 0.0
        for _ in range(depth - 1):
            lost = (1 - (1 - lost) / (threshold * T)) ** k
        if k >= least_alike(threshold):
            drawn = range(max(0, more - (T - k)), min(k, more) + 1)
            weight *= lost ** (each * k) * sum(math.comb(k, j) * math.comb(T - k, more - j) / math.comb(T, more) * lost**j for j in drawn)
        total += weight
    return total


def draw_roots(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> list[tuple[int, int]]:
    """The roots (run, position), as many as miss a pair at the threshold with probability 1 - recall at most."""
    order = np.random.default_rng(11).permutation(T).tolist()
    for n in range(1, 64 * T):
        if missed(n, threshold, depth) <= 1 - recall:
            return [(i // T, order[i % T]) for i in range(n)]
    raise ValueError("signatures of this length cannot reach the recall")


def _shingles(texts: list, length: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text with words is one shingle of its own."""
    words, starts = word_hashes(texts)
    hashes = RunHash(words)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        n = b - a
        if n >= length:
            out.append(np.unique(hashes(np.arange(a, b - length + 1), length)))
        else:
            out.append(hashes(np.array([a]), n) if n else np.zeros(0, np.uint64))
    return out


def _identity(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart; empty for the empty set."""
    return np.array([mixed(shingles).sum(dtype=np.uint64), mixed(shingles ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64) + np.uint64(len(shingles))], "<u8").tobytes() if len(shingles) else b""


def _signature(shingles: np.ndarray) -> np.ndarray:
    """T minimum hashes of 32 bits."""
    least = np.full(T, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(shingles), 2048):
        h = (shingles[a : a + 2048, None] * _A + _B) >> np.uint64(32)
        least = np.minimum(least, h.min(0).astype(np.uint32))
    return least


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = _shingles(batch.column("text").to_pylist(), shingle)
            sids = [_identity(x) for x in sets]
            made: dict[bytes, tuple[bytes, bytes]] = {}
            for sid, x in zip(sids, sets):
                if sid not in made:
                    sig = _signature(x)
                    made[sid] = sig.tobytes(), sig.astype(np.uint8).tobytes()
            columns = [pa.array(x, pa.binary()) for x in (sids, *zip(*(made[x] for x in sids)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), *columns], names=["doc", "h", "sid", "sig", "brief"])

    return run


def _bounds(*columns: np.ndarray) -> list[tuple[int, int]]:
    change = np.zeros(len(columns[0]), bool)
    for x in columns:
        change[1:] |= x[1:] != x[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), len(change)]
    return list(zip(cuts, cuts[1:]))


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for a symmetric matrix of links."""
    root = np.arange(len(linked))
    links = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(links, root, len(root)).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _equal(sig: np.ndarray) -> np.ndarray:
    """How many positions each two signatures have equal."""
    equal = np.zeros((len(sig), len(sig)), np.int16)
    for t in range(T):
        equal += sig[:, t, None] == sig[None, :, t]
    return equal


def _briefs(column: pa.ChunkedArray) -> np.ndarray:
    """A byte of each minimum hash. Bytes are equal where the hashes are, and else in one place of 256: what is compared by them
    is never missed, and what is too much falls to the exact step."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, T)


def _leaf(least_equal: int):
    """Links a, b of what is alike in each (node, chunk): each member of a component with its first one."""

    def use(table: pa.Table) -> pa.RecordBatch | None:
        node, chunk = table["node"].to_numpy(), table["chunk"].to_numpy()
        sid, sig = table["sid"].to_pylist(), _briefs(table["brief"])
        a: list[int] = []
        b: list[int] = []
        for i, j in _bounds(node, chunk):
            if j - i == 2:
                if np.count_nonzero(sig[i] == sig[i + 1]) >= least_equal:
                    a.append(sid[i])
                    b.append(sid[i + 1])
            elif j - i > 2:
                root = _roots(_equal(sig[i:j]) >= least_equal)
                for k in np.flatnonzero(root != np.arange(j - i)).tolist():
                    a.append(sid[i + int(root[k])])
                    b.append(sid[i + k])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return use


def _around_pivots(least_equal: int):
    """For each member dealt to a (node, chunk): the first member of its component there, and which pivots that has."""

    def use(table: pa.Table) -> pa.RecordBatch | None:
        node, chunk = table["node"].to_numpy(), table["chunk"].to_numpy()
        sid, sig, bits = table["sid"].to_pylist(), _briefs(table["brief"]), table["bits"].to_numpy()
        to: list[int] = []
        held = np.zeros(len(sid), np.int32)
        for i, j in _bounds(node, chunk):
            root = _roots(_equal(sig[i:j]) >= least_equal)
            of = np.zeros(j - i, np.int32)
            np.bitwise_or.at(of, root, bits[i:j])
            held[i:j] = of[root]
            to += [sid[i + k] for k in root.tolist()]
        return pa.RecordBatch.from_arrays([table["node"].combine_chunks(), pa.array(sid, pa.int64()), pa.array(to, pa.int64()), pa.array(held), table["dealt"].combine_chunks()], names=["node", "sid", "to", "held", "dealt"])

    return use


def _by_group(met: DataFrame, classes: DataFrame, keys: list[str], use: Callable, schema: str) -> DataFrame:
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.join(classes.select("sid", "brief"), "sid").repartition(parts, *keys).sortWithinPartitions(*keys, "sid")
    return dealt.mapInArrow(in_groups(keys, use), schema)


def around_pivots(large: DataFrame, classes: DataFrame, least_equal: int, chunk: int = CHUNK) -> DataFrame:
    """node, sid, to, held and dealt for the members of large nodes (large: node, n, sid).

    A node is dealt into chunks of about `chunk` members, and PIVOTS of its members join every chunk, so that no task has
    a whole node. `to` is a member of the same component in the chunk; bit k of held tells that the component has pivot
    k: all members that hold one pivot are alike through it, whatever their chunk. Pivots outside their own chunk
    come with dealt false."""
    spread = F.ceil(F.col("n") / chunk).cast("int")
    own = large.select("node", F.pmod(F.xxhash64("node", "sid"), spread).cast("int").alias("chunk"), "sid", F.lit(0).alias("bits"), F.lit(True).alias("dealt"))
    heads = [F.min(F.struct(F.xxhash64(F.lit(k), "sid"), "sid")).getField("sid").alias(f"s{k}") for k in range(PIVOTS)]
    pivots = large.groupBy("node").agg(F.max("n").alias("n"), *heads)
    each = F.array(*[F.struct(F.col(f"s{k}").alias("sid"), F.lit(1 << k).alias("bits")) for k in range(PIVOTS)])
    pivots = pivots.select("node", F.explode(F.sequence(F.lit(0), spread - 1)).alias("chunk"), each.alias("s")).select("node", "chunk", F.inline("s"))
    both = own.unionByName(pivots.withColumn("dealt", F.lit(False)))
    both = both.groupBy("node", "chunk", "sid").agg(F.sum("bits").cast("int").alias("bits"), F.max("dealt").alias("dealt"))
    return _by_group(both, classes, ["node", "chunk"], _around_pivots(least_equal), "node long, sid long, to long, held int, dealt boolean")


def across(named: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, chunk and sid: pairs of blocks of each node, in which every two of its members stand together unless both
    are of its main group. named: node, sid, is_main.

    The main group (members that are alike through one pivot) comes in blocks of its own, which meet the blocks of all
    other members but not each other, so a node of one group costs nothing."""
    shares = named.groupBy("node").agg(F.count_if("is_main").alias("most"), F.count_if(~F.col("is_main")).alias("others")).where("others > 0")
    count = lambda n: F.ceil(F.col(n) / block).cast("int")
    nodes = shares.select("node", count("others").alias("rest"), count("most").alias("mains"))
    code = F.xxhash64(F.lit(5), "sid")
    own = F.when(F.col("is_main"), F.col("rest") + F.pmod(code, F.col("mains"))).otherwise(F.pmod(code, F.col("rest"))).cast("long")
    both = F.col("rest") + F.col("mains")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("rest")).otherwise(both) - 1))
    placed = named.join(nodes, "node").select("node", "sid", own.alias("own"), both.alias("both"), other.alias("other"))
    return placed.select("node", (F.least("own", "other") * F.col("both") + F.greatest("own", "other")).alias("chunk"), "sid")


def leaves(classes: DataFrame, threshold: float, roots: list[tuple[int, int]], leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """node, chunk and sid: what is to be compared by brute force; links (a, b) that were found on the way; and the tables that
    both read.
    classes: sid (a number), sig, brief.

    A node of at most `leaf` members is a leaf. In a larger one all members meet its pivots. Those alike through one
    pivot are one group, of which no pair need be looked at again; if the others are a leaf or fewer (or the level is
    the last), they meet each other and the group in pairs of blocks, and the node is done. So a group of near copies
    ends in the first node that holds it, and only nodes of many different texts are split."""
    # four bytes of the signature, as a number
    at = lambda p: F.substring("sig", p * 4 + 1, 4)
    first = F.array(*[F.xxhash64(F.lit(run), F.lit(p), F.substring("sig", p * 4 + 1, 4)) for run, p in roots])
    members = classes.select("sid", F.explode(first).alias("node"))  # made twice: that costs less than to keep it
    out: list[DataFrame] = []
    links: list[DataFrame] = []
    kept: list[DataFrame] = []
    for level in range(1, depth + 1):
        if level > 1:
            members = save(members, f"members{level}")
        sizes = save(members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), f"sizes{level}")
        # one shuffle of all members, and what is alone in its node is gone
        sized = save(members.join(sizes, "node"), f"sized{level}")
        kept.append(sized)
        out.append(sized.where(F.col("n") <= leaf).select("node", F.lit(0).cast("long").alias("chunk"), "sid"))
        large = sized.where(F.col("n") > leaf)
        if sizes.where(F.col("n") > leaf).isEmpty():
            break
        met = save(around_pivots(large, classes, least_alike(threshold), min(CHUNK, leaf)), f"pivots{level}")
        kept.append(met)
        links.append(met.where("sid <> to").select(F.col("sid").alias("a"), F.col("to").alias("b")))
        met = met.where("dealt")
        holds = lambda k: F.col("held").bitwiseAND(1 << k) > 0
        counts = met.groupBy("node").agg(F.count("*").alias("n"), *[F.count_if(holds(k)).alias(f"n{k}") for k in range(PIVOTS)])
        main = F.greatest(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(1 << k).alias("bit")) for k in range(PIVOTS)])
        counts = save(counts.select("node", main["bit"].alias("bit"), (F.col("n") - main["n"]).alias("others")).where("others > 0"), f"mains{level}")
        done = counts if level == depth else counts.where(F.col("others") <= leaf)
        named = met.join(done, "node").select("node", "sid", (F.col("held").bitwiseAND(F.col("bit")) > 0).alias("is_main"))
        out.append(across(save(named, f"tiles{level}"), block))
        left = counts.where(F.col("others") > leaf)
        if level == depth or left.isEmpty():
            break
        draw = lambda p: F.pmod(F.xxhash64(F.lit(7), F.col("node"), p), F.lit(1 << 20)) < int((1 << 20) / (threshold * T))
        chosen = F.filter(F.sequence(F.lit(0), F.lit(T - 1)), draw)
        split = large.join(left.select("node"), "node").select("node", "sid").join(classes.select("sid", "sig"), "sid").select("sid", "node", "sig", F.explode(chosen).alias("p"))
        members = split.select("sid", F.xxhash64("node", "p", at(F.col("p"))).alias("node"))
    return reduce(DataFrame.unionByName, out), links, kept


def _shingle_sets(shingle: int):
    """Each class once for a task: rows alike in id and text are the same member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text"):
            new = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int32()))
            sets = _shingles(batch.column("text").to_pylist(), shingle)
            same = [i for i, (x, key) in enumerate(zip(sets, batch.column("key").to_pylist())) if _identity(x) == key]
            part = batch.take(pa.array(same, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("root", "size", "sid", "copies")), pa.array([sets[i].tobytes() for i in same], pa.binary())], names=["root", "size", "sid", "copies", "shingles"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count[code] > 1
    owner, code = owner[use], np.unique(code[use], return_inverse=True)[1] if use.any() else code[use]
    width = int(code.max()) + 1 if len(code) else 0
    out = np.zeros((n, n), np.float32)
    for a in range(0, width, 8192):
        part = (code >= a) & (code < a + 8192)
        has = np.zeros((n, min(8192, width - a)), np.float32)
        has[owner[part], code[part] - a] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _exact(threshold: Fraction):
    num, den = threshold.numerator, threshold.denominator

    def use(table: pa.Table) -> pa.RecordBatch | None:
        # a class that several tasks found is there once
        first = [True, *(a != b for a, b in pairwise(zip(*(table[x].to_pylist() for x in ("root", "i", "j", "sid")))))]
        table = table.filter(pa.array(first[: table.num_rows], pa.bool_()))
        root, i_, j_ = table["root"].to_numpy(), table["i"].to_numpy(), table["j"].to_numpy()
        own, sid, copies = table["own"].to_numpy(), table["sid"].to_pylist(), table["copies"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table["shingles"].to_pylist()]
        out: tuple[list, list, list] = ([], [], [])
        for a, b in _bounds(root, i_, j_):
            size = np.array([len(x) for x in sets[a:b]])
            both = _common(sets[a:b])
            # common / (sum - common) >= num / den
            linked = both * (num + den) >= num * (size[:, None] + size[None, :])
            np.fill_diagonal(linked, False)
            side = own[a:b]
            if i_[a] != j_[a]:
                judged = linked & (side[:, None] != side[None, :])
            else:
                judged = linked
            links = (judged * copies[a:b][None, :]).sum(1)
            roots = _roots(judged)
            for k in range(b - a):
                if i_[a] == j_[a] or links[k]:
                    out[0].append(sid[a + k])
                    out[1].append(sid[a + int(roots[k])])
                    out[2].append(int(links[k]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["sid", "to", "links"])

    return use


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, leaf: int = LEAF, block: int = BLOCK, text_hash: bool = False) -> DataFrame:
    """doc_id, class_id and n_links of every row (with text_hash: xxhash64 of the text too, which tells rows of one id
    apart): documents are linked when the Jaccard similarity of their sets of
    five-word shingles is at least 0.8; a class is a connected component, named by its smallest doc_id; n_links is how
    many other rows a row is linked with, copies included.

    Words are runs of anything but space and tab to carriage return, unchanged. A text of one to four words is one
    shingle, linked with equal texts only. Null, empty and blank texts have no shingles and link with nothing: each is
    its own class. A null doc_id counts as the smallest (class_id null). Rows of one id with different texts keep their own
    classes. Other columns are not read. Links are exact; a link can be missed only where both its texts meet neither
    directly nor through others in any run: below 1 - recall at the threshold, less above it."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), F.xxhash64("text").alias("h"), "text")
    signed = save(rows.mapInArrow(_sets(shingle), "doc long, h long, sid binary, sig binary, brief binary"), "signed")
    # a class is read again from the row of its least id and text hash, as an id may have several texts; on the way it is
    # known by its number in the written table
    classes = signed.where(F.length("sid") > 0).groupBy("sid").agg(F.min(F.struct("doc", "h")).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("brief").alias("brief"))
    numbered = classes.select(F.col("sid").alias("key"), F.monotonically_increasing_id().alias("sid"), F.col("least.doc").alias("rep"), F.col("least.h").alias("h"), "copies", "sig", "brief")
    classes = save(numbered, "classes")
    signatures = classes.select("sid", "sig", "brief")
    met, links, kept = leaves(signatures, threshold, draw_roots(recall, threshold), leaf, block=block)
    found = _by_group(met, signatures, ["node", "chunk"], _leaf(least_alike(threshold)), "a long, b long")
    provisional = components(reduce(DataFrame.unionByName, links, found))
    for table in kept:
        drop_saved(table)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = provisional.groupBy("root").agg(F.count("*").alias("size"))
    members = save(provisional.withColumnRenamed("node", "sid").join(sizes, "root").join(classes.select("sid", "key", "rep", "h", "copies"), "sid"), "members")
    # by sort and merge at every size: the members grow with the documents
    texts = rows.join(members.withColumnRenamed("rep", "doc").hint("merge"), ["doc", "h"]).select("root", "size", "sid", "key", "copies", "text")
    sets = texts.mapInArrow(_shingle_sets(shingle), "root long, size long, sid long, copies long, shingles binary")
    sets = save(sets, "sets")
    drop_saved(members)
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = sets.withColumn("own", F.pmod(F.xxhash64("sid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "copies", "shingles")
    judged = placed.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "sid").mapInArrow(in_groups(["root", "i", "j"], _exact(Fraction(threshold).limit_denominator(1000))), "sid long, to long, links long")
    judged = save(judged, "judged")
    drop_saved(sets)
    exact = components(judged.select(F.col("sid").alias("a"), F.col("to").alias("b")))
    links = judged.groupBy("sid").agg(F.sum("links").alias("links"))
    named = exact.withColumnRenamed("node", "sid").join(classes.select("sid", "rep"), "sid")
    heads = named.groupBy("root").agg(F.min("rep").alias("head"))
    result = named.join(heads, "root").select("sid", "head").join(links, "sid", "left")
    whole = classes.select("sid", "key", "rep", "copies").join(result, "sid", "left").select(F.col("key").alias("sid"), F.coalesce("head", "rep").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = signed.select("doc", "h", "sid").join(save(whole, "class-of"), "sid", "left")
    real = lambda c: F.when(c != _NULL, c)
    found = [real(F.col("doc")).alias("doc_id"), real(F.coalesce("head", "doc")).alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links")]
    return out.select(*found, *([F.col("h").alias("text_hash")] if text_hash else []))


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p, ws FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p+4], ' ') AS x FROM s),
n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM m JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 9 * same >= 4 * (x.c + y.c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b)
SELECT d.doc_id, min(r.root) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_links
FROM documents d JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""
