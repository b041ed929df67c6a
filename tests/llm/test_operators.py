"""Small fixtures with nulls, empty and long texts, ties, repeats, empty tables and clashing columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact_dedup, idfile, line_dedup, near_join, packing, quality, sharding, substring, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = {
    1: "A line that many share.\nown words here and there\n  A LINE that many share.\t",
    2: "a line that many share.\r\nshort\n" + BASE,
    3: BASE + " tail",
    4: BASE.replace("w59", "x59"),
    5: None,
    6: "",
    7: " \t\n",
    8: "It's 12 o'clock — ünïcödé\x85 　 <|endoftext|> 😀   end  ",
    9: "It's12o'clock—ünïcödé\x85　<|endoftext|>😀end",
    10: ("lorem ipsum dolor " * 3000).strip(),
    11: " ".join(f"w{i}" for i in range(20, 45)),
    12: "two words",
    13: "two words",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, None, "s", None if t is None else len(t)) for k, t in TEXTS.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_is_tiktoken_and_comes_back(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    found = by_id(bpe.round_trip(docs, path, P.PATTERN))
    for k, t in TEXTS.items():
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert found[k].n_tokens == len(ids) and found[k].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert found[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(docs.withColumnRenamed("lang", "ids"), path, P.PATTERN), path, P.PATTERN)  # a clashing column
    assert {r.doc_id: bytes(r.decoded).decode() for r in both.collect()} == {k: t or "" for k, t in TEXTS.items()}
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_quality_learns_and_keeps_held_out_rows_apart(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary, 40)) if i % 3 else "spam!! " * 30, i % 3 and 1) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(q))) for i, _, q in rows] + [(1, None)], "doc_id long, quality int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == 602 and all(0 <= r.score <= 1 for r in found)
    for r in found:
        if r.doc_id is not None and r.doc_id < 600:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert r.predicted == (1 if r.doc_id % 3 else 0)
    one = quality.classify(docs, labels.where("quality = 1"))
    assert one.where("predicted = 1").count() == 602


def test_bpe_rows_of_no_or_one_id(spark):
    rows = spark.createDataFrame([(None, "no id"), (1, "same"), (1, "same"), (1, None)], "doc_id long, text string")
    found = bpe.round_trip(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in found) == Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in map(tuple, rows.collect()))


def test_support_vectors_against_a_plain_solver():
    rng = np.random.default_rng(4)
    features = [np.unique(rng.integers(0, 30, int(rng.integers(3, 12)))) for _ in range(50)]
    labels = np.array([int((x < 13).mean() + rng.normal() * 0.2 > 0.4) for x in features])
    got, bias = quality.fit_rows(features, labels, c=0.7, epochs=4000)
    # log-count ratios by hand
    held = np.zeros((50, 30))
    for i, x in enumerate(features):
        held[i, x] = 1
    n = np.bincount(labels)
    up, down = held[labels == 1].sum(0), held[labels == 0].sum(0)
    ratio = np.where(up + down > 0, np.log((up + 1) / (n[1] + 2)) - np.log((down + 1) / (n[0] + 2)), 0)
    v = held * ratio / np.sqrt(held.sum(1, keepdims=True))
    sign, most = np.where(labels == 1, 1.0, -1.0), 0.7 * 50 / (2 * n[labels])
    q = (v @ v.T + 1) * np.outer(sign, sign)
    dual, step = np.zeros(50), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):  # projected gradient on the dual
        dual = np.clip(dual - step * (q @ dual - 1), 0, most)
    w, b = (dual * sign) @ v, (dual * sign).sum()
    assert abs(bias - b) < 5e-3 and np.abs(got[:30] - w * ratio).max() < 5e-3 and not got[30:].any()


def test_quality_bounds_what_the_driver_gets(spark, monkeypatch):
    rows = [(7, "good words here", 1)] * 300 + [(i, f"text {i} " * (i % 9), i % 2) for i in range(1000, 1100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    seen = []
    real = quality.fit_rows
    monkeypatch.setattr(quality, "fit_rows", lambda f, y, **k: seen.append((len(f), sum(map(len, f)))) or real(f, y, **k))
    quality.fit(df, max_rows=40)
    quality.fit(df, max_rows=400, max_grams=700)
    assert seen[0][0] <= 40 and seen[1][1] <= 700 and seen[1][0] > 10
    assert quality.fit(df.limit(0)).slope == 0.0


def test_quality_scores_every_row(spark):
    docs = spark.createDataFrame([(1, "a text", 0.5), (1, "a text", 0.1), (2, None, 0.2), (None, "", 0.3), (3, "word " * 200_000, 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    found = quality.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter({1: 2, 2: 1, 3: 1, None: 1}) and all(0 <= r.score <= 1 for r in found)
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == 5


def test_near_join_is_exact_on_fixture(docs, empty):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for k, t in TEXTS.items()}
    links, parent = Counter(), {k: k for k in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = by_id(near_join.near_duplicates(docs))
    assert {k: (r.class_id, r.n_links) for k, r in found.items()} == {k: (root(k), links[k]) for k in sets}
    assert sum(links.values()) > 0 and near_join.near_duplicates(empty).count() == 0


def test_near_join_counts_repeated_rows_once_each(spark):
    near = BASE + " " + " ".join(f"y{i}" for i in range(60))
    rows = [(1, near), (1, near), (1, "other text of the same id, alone"), (2, near + " end"), (None, near + " end"), (None, "no id, alone"), (3, None)]
    found = near_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, found)) == Counter({(1, None, 3): 2, (1, 1, 0): 1, (2, None, 3): 1, (None, None, 3): 1, (None, None, 0): 1, (3, 3, 0): 1})


def test_near_join_splits_large_nodes(spark):
    rng = np.random.default_rng(1)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(300):  # a group of different near copies, larger than a leaf
        w = list(base)
        w[int(rng.integers(200))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(80))) for i in range(50)]
    found = by_id(near_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=16, block=64))
    assert all(found[i].class_id == 0 and found[i].n_links == 299 for i in range(300))
    assert all(found[1000 + i].class_id == 1000 + i and found[1000 + i].n_links == 0 for i in range(50))


def test_near_join_reaches_its_recall_at_the_last_level(spark):
    rows = []
    for i in range(3000):  # pairs of 72 shingles each, 64 of them common: 64 / 80
        common = [f"c{i}_{j}" for j in range(68)]
        rows += [(2 * i + k, " ".join([*common, *(f"o{i}_{k}_{j}" for j in range(8))])) for k in (0, 1)]
    # no leaf at all: every pair has to come through to the last level
    found = near_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=1)
    assert found.where("n_links = 1").count() >= 2 * 2998


def test_near_join_compares_all_of_a_large_last_node(spark):
    # node 1: one group of 60 classes and 31 others; node 2: one group alone; node 3: no group at all
    large = [(1, f"m{i}") for i in range(60)] + [(1, f"r{i}") for i in range(31)] + [(2, f"m{i}") for i in range(40)] + [(3, f"r{i}") for i in range(25)]
    rows = near_join.across(spark.createDataFrame([(n, k, k[0] == "m") for n, k in large], "node long, sid string, is_main boolean"), block=8).collect()
    groups, met = defaultdict(list), defaultdict(set)
    for r in rows:
        groups[r.node, r.chunk].append(r.sid)
    for (node, _), ks in groups.items():
        assert len(ks) <= 40
        met[node] |= {(a, b) for a in ks for b in ks}
    assert 2 not in met
    for node in (1, 3):
        ks = [k for n, k in large if n == node]
        assert all((a, b) in met[node] for a in ks for b in ks if a == b or not a[0] == b[0] == "m")


def brute_links(texts):
    """Links and classes of texts by an index of all shingles."""
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for k, t in texts.items()}
    holders, same = defaultdict(list), Counter()
    for k in sorted(sets):
        for x in sets[k]:
            same.update((j, k) for j in holders[x])
            holders[x].append(k)
    linked, root = Counter(), {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in same.items():
        if n * 9 >= 4 * (len(sets[a]) + len(sets[b])):
            linked.update((a, b))
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {k: (top(k), linked[k]) for k in sets}


def test_near_join_ends_a_group_of_near_copies_at_its_first_node(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"v{i}" for i in range(120)]
    texts = {}
    for i in range(700):  # one group around a base, members mostly just above or below the threshold to each other
        w = list(base)
        for j in rng.choice(120, 2, replace=False):
            w[j] = f"e{i}_{j}"
        texts[i] = " ".join(w)
    for i in range(300):  # texts that share a passage with the group and with one another, but are not alike
        texts[1000 + i] = " ".join(base[:30] + [f"o{i}_{j}" for j in range(60)])
    levels = []
    real = near_join.around_pivots
    monkeypatch.setattr(near_join, "around_pivots", lambda large, *x: levels.append(large.count()) or real(large, *x))
    found = by_id(near_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), leaf=64, block=128))
    want = brute_links(texts)
    missed = sum(abs(found[k].n_links - n) for k, (_, n) in want.items()) / sum(n for _, n in want.values())
    assert missed == 0 and all(found[k].class_id == c for k, (c, _) in want.items())
    assert sum(levels) <= 2.5 * levels[0]  # what goes on to further levels does not take the group along at each


def test_near_join_finds_all_links_of_a_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute_links({r.doc_id: r.text for r in docs.collect()})
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(docs, leaf=8).collect()}
    assert found == want and sum(n for _, n in want.values()) > 100


def test_sharding_is_exact_and_gapless(spark, docs, empty):
    rows = docs.unionByName(docs).withColumnRenamed("lang", "shard").drop("source")  # repeated rows, a clashing column
    found = sharding.shuffle_shards(rows, ["doc_id", "text"], 5).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [5, 5, 5, 5, 6]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter(r["doc_id"] for r in found) == Counter({k: 2 for k in TEXTS})
    assert sharding.shuffle_shards(empty, ["doc_id"]).count() == 0


def test_hypergeometric_is_the_exact_distribution(spark):
    from math import comb

    cases = [(0, 5, 5), (5, 0, 9), (7, 6, 9), (10, 40, 3), (60, 50, 70), (9, 9, 0), (300, 500, 4000)]
    steps = 4000
    grid = spark.range(steps).select((F.col("id") + 0.5).alias("u"))
    drawn = grid.select(*[sharding.hypergeometric(F.lit(d), F.lit(g), F.lit(b), F.col("u") / steps).alias(f"c{i}") for i, (d, g, b) in enumerate(cases)]).toPandas()
    for i, (d, g, b) in enumerate(cases):
        weights = np.array([comb(g, k) * comb(b, d - k) if 0 <= d - k <= b else 0 for k in range(min(d, g) + 1)], object)
        want = np.array([float(x / sum(weights)) for x in np.cumsum(weights)])
        have = np.array([(drawn[f"c{i}"] <= k).mean() for k in range(len(want))])
        assert np.abs(have - want).max() < 1.5 / steps


def test_sharding_is_uniform_and_keeps_documents_whole(spark):
    rows = [(i, f"text {i % 50}") for i in range(3000)] + [(None, None), (None, None), (5, "x"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("own"))
    found = sharding.shard_documents(docs, shards=6).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    slots = defaultdict(list)
    for r in found:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append((r.slot, r.doc_id))
    assert sorted(map(len, slots.values())) == [500, 500, 501, 501, 501, 501]
    low = []
    for own in slots.values():
        own.sort(key=lambda x: x[0])
        assert [x for x, _ in own] == list(range(len(own)))
        ids = [k for _, k in own if k is not None]
        low.append(sum(k < 1500 for k in ids))
        assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.2  # places do not follow ids
    # of 500 rows drawn without replacement half are low, with a deviation of ten
    assert all(abs(x - 250) < 50 for x in low)
    other = sharding.shard_documents(docs, shards=6, seed=2).collect()
    assert sum(a.shard == b.shard for a, b in zip(sorted(found, key=lambda r: (r.doc_id or -1, r.slot)), sorted(other, key=lambda r: (r.doc_id or -1, r.slot)))) < 700


def test_substring_dedup_against_brute_force(docs, empty):
    first = {}
    for k in sorted(TEXTS):
        w = words(TEXTS[k])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    found = by_id(substring.remove_spans(docs.withColumnRenamed("lang", "kept_text")))
    digests = by_id(substring.digest(docs))
    for k, t in TEXTS.items():
        w = words(t)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (found[k].n_words, found[k].n_removed, found[k].kept_text) == (len(w), len(gone), kept)
        assert digests[k].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert substring.digest(empty).count() == 0


def test_factors_are_longest_and_go_on_at_their_ends():
    # block 0: documents 1 (two runs), 2 and 3; block 1: the same windows again, of document 0
    runs = [(0, 1, [1, 2, 3, 4]), (0, 1, [7, 8]), (0, 2, [2, 3, 7, 9, 1, 2, 3]), (0, 3, [9, 1, 5, 3, 4, 8]), (1, 0, [9, 9, 9])]
    block, doc = (np.array(x) for x in zip(*[r[:2] for r in runs]))
    starts = np.cumsum([0, *[len(r[2]) for r in runs]])
    found = substring.factors(block, doc, starts, np.array([w for r in runs for w in r[2]]))
    assert sorted(zip(*(x.tolist() for x in found))) == [(2, 0, 2), (2, 2, 1), (2, 4, 3), (3, 0, 2), (3, 3, 2), (3, 5, 1)]
    assert [len(x) for x in substring.factors(block[:0], doc[:0], np.zeros(1, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]


@pytest.mark.parametrize("block_runs", [8192, 3])
def test_substring_dedup_of_shared_passages(spark, block_runs):
    rng = np.random.default_rng(7)
    passages = [[f"p{i}_{j}" for j in range(40)] for i in range(4)] + [["la"] * 30]
    rows = [(5, None), (None, " ".join(passages[0])), (None, " ".join(passages[1][5:30])), (6, ""), (7, "x" * 100_000)]
    for k in range(40):
        text: list[str] = []
        for _ in range(3):  # parts of passages, between words of its own
            cut = passages[int(rng.integers(5))]
            a = int(rng.integers(10))
            text += [f"d{k}_{x}" for x in range(int(rng.integers(6)))] + cut[a : a + int(rng.integers(10, 30))]
        rows.append((k + 10, " ".join(text)))
    rows += rows[10:14]  # repeated rows
    first = {}
    for k, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), -1 if k is None else k)
    want = Counter()
    for k, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < (-1 if k is None else k) for j in range(i, i + 13)}
        want[k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = substring.duplicate_spans(docs, block_runs=block_runs)
    assert spans.count() > 20
    plain = substring.duplicate_spans
    try:
        substring.duplicate_spans = lambda *x: plain(*x, block_runs=block_runs)
        found = Counter(map(tuple, substring.remove_spans(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()))
    finally:
        substring.duplicate_spans = plain
    assert found == want and sum(x[2] for x in want) > 100


def test_id_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "null key"), (3, TEXTS[3])], "doc_id long, text string"))
    parts = idfile.write(rows, P.path("byte_bpe_50k.json"), P.PATTERN)
    found = sorted(idfile.read(parts).collect(), key=lambda r: r.start)
    start = 0
    for r, (k, t) in zip(found, [(None, "null key"), *sorted([*TEXTS.items(), (3, TEXTS[3])], key=lambda x: x[0])]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(TEXTS) + 2
    asked = spark.createDataFrame([(3,), (8,), (None,), (99,), (8,), (-7,)], "doc_id long")
    got = {r.doc_id: r.ids for r in idfile.lookup(parts, asked).collect()}
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in ((3, TEXTS[3]), (8, TEXTS[8]), (None, "null key"))}
    assert got == want | {99: None, -7: None}
    none = idfile.write(empty, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert idfile.read(none).count() == 0 and [r.ids for r in idfile.lookup(none, asked.limit(1)).collect()] == [None]


def test_id_files_split_rows_of_one_key(spark):
    rows = spark.createDataFrame([(None if i % 3 else i, "same text " * (i % 3)) for i in range(900)], "doc_id long, text string").repartition(6)
    parts = idfile.write(rows, P.path("byte_bpe_50k.json"), P.PATTERN, shard_rows=100)
    assert parts.where(f"low = {-(1 << 63)}").select("shard").distinct().count() >= 4  # null keys are no single shard
    found = sorted(idfile.read(parts).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 600 + list(range(0, 900, 3))
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    assert idfile.part_starts(parts, span=2).orderBy("shard", "part").collect() == idfile.part_starts(parts).orderBy("shard", "part").collect()
    long = spark.createDataFrame([(1, "word " * 900_000), (2, None)], "doc_id long, text string")  # more than a part
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in idfile.read(idfile.write(long, P.path("byte_bpe_50k.json"), P.PATTERN)).collect())[1][2] == 1


def test_perfect_hash_finds_keys_and_refuses_others():
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 3000))
    part = idfile.Part(*idfile.write_part(keys, [bytes([i % 251, 0]) for i in range(len(keys))], 2))
    assert (part.find(keys) == np.arange(len(keys))).all()
    others = np.arange(2000)
    assert (part.find(others) >= 0).sum() <= 1 and part.of(int(keys[7])).tolist() == [7] and part.of(5) is None


def test_perfect_hash_takes_another_seed():
    keys = np.unique(np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 30000))  # a bucket fits nowhere under the first seed
    part = idfile.Part(*idfile.write_part(keys, [bytes([i % 251, 0]) for i in range(len(keys))], 2))
    assert part.seed > 0 and (part.find(keys) == np.arange(len(keys))).all()


def test_perfect_hash_places_buckets_together(monkeypatch):
    calls, plain = [], idfile.mix
    monkeypatch.setattr(idfile, "mix", lambda *x: calls.append(1) or plain(*x))
    for n in (0, 1, 2, 5, 3000):
        keys = np.arange(n) * 7 - 900
        moved, seed = idfile.perfect_hash(keys)
        assert sorted(idfile.slots(keys, moved, seed, n).tolist()) == list(range(n)) if n else len(moved) == 1
    assert len(calls) < 500  # one or more for each of 1000 buckets if they are placed one by one


def test_library_coder_encodes_a_word_once_by_the_model():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder = bpe.library_coder.__wrapped__(P.path("byte_bpe_50k.json"), P.PATTERN, 40)
    texts = ["", " ", "a  b\n\n c\t", "it's  we''ll '", "Größe ñandú – “quoted” …", "Привет, мир 你好 안녕 ไทย हिन्दी 😀 \U0001f1e9", "\u0558 a\u208f \ua7ce 1\U00010940", "<|endoftext|> in <|endoftext|>", "x" * 99 + " " + "x" * 99]
    texts += [" ".join(f"w{i * j}," for i in range(30)) for j in range(9)]
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts]
    asked = []
    words = coder.coder.encode
    coder.coder.known.encode = lambda word: asked.append(word) or words(word)
    assert coder(texts) == want and len(asked) == len(set(asked)) and not any(len(x) > bpe.CACHED_CHARS for x in coder.coder.known)
    assert all(coder([x]) == [y] for x, y in [*zip(texts, want)] * 2) and len(coder.coder.known) <= 40 + 120  # the oldest half stays
    other = bpe.library_coder.__wrapped__(P.path("byte_bpe_50k.json"), r"\S+|\s+")  # not the library's own splitting
    assert type(other.coder) is bpe.Cached


def test_splitters_agree_on_settled_characters():
    import re

    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json")).pre_tokenizer
    assert P.PATTERN == bpe.BYTE_LEVEL
    settled = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10FFFF, 97)]) if not re.search(bpe.UNSETTLED, c)]
    assert len(settled) > 50_000
    for a in range(0, len(settled), 500):
        text = "".join(f" a{c} 1{c} !{c} {c}b" for c in settled[a : a + 500])
        assert [text[i:j] for _, (i, j) in library.pre_tokenize_str(text)] == regex.findall(bpe.BYTE_LEVEL, text)


def test_id_file_parts_have_bounded_keys(spark, monkeypatch):
    monkeypatch.setattr(idfile, "PART_KEYS", 7)
    rows = spark.createDataFrame([(i, None) for i in range(100)], "doc_id long, text string")
    parts = idfile.write(rows, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert parts.agg({"docs": "max"}).first()[0] == 7
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in idfile.read(parts).collect()) == [(i, i, 1) for i in range(100)]


def test_packing_places_every_id_once(docs, empty):
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, room=64, open_windows=2, merge=2).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k in TEXTS:
        own = sorted(by_doc[k], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert sum(r.length for r in own) == own[0].doc_tokens
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert sum(r.length for r in own) <= 64
    assert packing.pack(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_packing_is_the_librarys_ids_and_close_to_full(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(12)
    texts = [(i, " ".join(f"word{x}" for x in rng.integers(0, 999, int(rng.integers(0, 90))))) for i in range(400)]
    texts += [(None, "no id"), (3, texts[3][1]), (7, "other text of an id"), (500, None), (501, "Ünï <|endoftext|> code " * 700)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("offset", F.lit("own")).repartition(3)
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, room=256, open_windows=16, merge=2).collect()
    want, total = Counter(), 0
    for k, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for a in range(0, len(ids), 256):
            want[k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    # plain best fit of the same pieces, longest first, in unbounded space
    fills: list[int] = []
    for n in sorted((x[2] for x in want.elements()), reverse=True):
        fits = [f for f in fills if f + n <= 256]
        if fits:
            fills.remove(max(fits))
            fills.append(max(fits) + n)
        else:
            fills.append(n)
    sequences = len({r.sequence_id for r in rows})
    assert sequences <= 1.05 * len(fills) + 1 and total / (256 * sequences) > 0.93


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup_against_brute_force(docs, empty, batches):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first, holders = {}, defaultdict(set)
    for k in sorted(TEXTS):
        for x in (TEXTS[k] or "").split("\n"):
            first.setdefault(key(x), k)
            holders[key(x)].add(k)
    found = by_id(line_dedup.dedup_lines(docs.withColumnRenamed("lang", "n_lines"), batches=batches, fanout=2))
    for k, t in TEXTS.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or first[key(x)] == k]
        assert (found[k].n_lines, found[k].n_dropped, found[k].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.digest(empty).count() == 0


def test_line_dedup_of_no_id_and_repeated_rows(spark):
    rows = [(None, "a shared line of text\nnull only"), (None, "a shared line of text\nsecond text of no id"), (4, "A SHARED line of text \nown words alone"), (4, "own words alone\na shared line of text\nown words alone"), (4, "A SHARED line of text \nown words alone"), (6, "own words alone\nown words alone"), (7, "\n" * 50_000 + "a shared line of text")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kept = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found)
    want = [(None, 2, 0, rows[0][1]), (None, 2, 0, rows[1][1]), (4, 2, 1, "own words alone"), (4, 3, 1, "own words alone\nown words alone"), (4, 2, 1, "own words alone"), (6, 2, 2, ""), (7, 50_001, 1, "\n" * 49_999)]
    assert kept == Counter(want)


def test_line_runs_merge_and_compact(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(f"k{k}".encode(), i) for k in range(i, i + 3)] * 2, "key binary, doc int"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    plan = runs.all()[0].join(spark.createDataFrame([(b"k1",)], "key binary").hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the run is merged where it lies
    assert {bytes(r.key).decode(): r["first"] for r in runs.table().collect()} == {f"k{k}": max(0, k - 2) for k in range(7)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run")]


def test_exact_dedup_keeps_one_of_each_group(spark, docs, empty):
    rows = docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(None, TEXTS[10] + " ", None, None, None)], SCHEMA))
    found = exact_dedup.mark_copies(rows, block_chars=7).collect()
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    sizes = Counter(body(r.text) for r in rows.collect())
    texts = {**TEXTS, None: TEXTS[10]}
    assert len(found) == len(TEXTS) + 2
    for r in found:
        assert r.group_size == sizes[body(texts[r.doc_id])]
        assert r.text_sha256 == hashlib.sha256(body(texts[r.doc_id]).encode()).hexdigest()
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(sizes)
    best = {r.doc_id: r.keep_id for r in found}
    assert best[9] == 8 and best[13] == 12 and best[10] is None and best[5] == 7 and best[6] == 7
    assert exact_dedup.mark_copies(empty).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.integers(-3, 4, 10) / 64).tolist()) for i in range(0, 400)]
    vectors += [(7, vectors[7][1]), (500, None), (520, [float("nan")] * 10), (540, [None] + [0.0] * 9), (None, [1.0] * 10), (560, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = topk.top_k(df, block_rows=96, chunk_queries=8).collect()
    x = np.floor(64 * np.array([v for _, v in vectors[:400]])).astype(int)
    for q in range(0, 400, 20):
        scores = x @ x[q]
        order = [i for i in sorted(range(400), key=lambda i: (-scores[i], i)) if i != q][:20]
        assert [(r.rank, r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(j + 1, i, scores[i]) for j, i in enumerate(order)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_counts_repeated_rows_and_pads_short_vectors(spark):
    rng = np.random.default_rng(13)
    rows = [(i, (rng.integers(-3, 4, int(rng.integers(0, 6))) / 64).tolist()) for i in range(130)]
    rows += [rows[33]] * 24 + [rows[40], (40, [5 / 64, 1 / 64]), (45, [9 / 64]), (45, [8 / 64])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), block_rows=20, chunk_queries=2).collect()
    full = [(k, [int(64 * x) for x in v] + [0] * (6 - len(v))) for k, v in rows]
    for q in range(0, 130, 20):
        own = min(v + [] for k, v in full if k == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), k) for k, v in full if k != q)[:20]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert got == [(i + 1, k, -s) for i, (s, k) in enumerate(scored)]


@pytest.mark.parametrize("scale", [1 << 21, 1 << 40])
def test_topk_keeps_large_finite_vectors(spark, scale):
    rng = np.random.default_rng(6)
    vectors = [[int(x) for x in rng.integers(-3, 4, 8)] for _ in range(100)]
    vectors[13] = [scale, -scale, 0, 3, -1, scale, 2, 0]
    vectors[40] = [-(1 << 21), 2, 0, 1 << 21, -1, 0, 1, 1]
    vectors[60] = []
    if scale > 1 << 21:  # products beyond a long that cancel out
        vectors[20] = [1 << 40, 1 << 40, 0, 1, 0, 0, 0, 0]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = topk.top_k(df, block_rows=40, chunk_queries=4).collect()
    x = [[64 * y for y in v] for v in vectors]
    for q in range(0, 100, 20):
        scores = [sum(a * b for a, b in zip(x[q], v)) for v in x]
        order = [i for i in sorted(range(100), key=lambda i: (-scores[i], i)) if i != q][:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(i, scores[i]) for i in order]


def test_topk_answers_any_finite_vector(spark):
    rng = np.random.default_rng(8)
    vectors = [[float(x) for x in rng.integers(-3, 4, 4)] for _ in range(100)]
    vectors[0], vectors[20], vectors[60] = [0.0, 3.0, -1.0, 0.0], [0.0, 1.5, 2.0, 0.0], [0.0, -(2.0**40), 1.0, 0.0]
    for q in (40, 80):
        vectors[q][0] = vectors[q][3] = 0.0
    vectors[5], vectors[6], vectors[7] = [2.0**60, 1.0, 2.0, 0.0], [-1.7e308, 0.25, 0.0, 1.7e308], [1.0, 2.0**40, 0.0, 0.0]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = topk.top_k(df, block_rows=30, chunk_queries=2).collect()
    x = [[int(y * 64) if abs(y) < 2**40 else int(y) * 64 for y in v] for v in vectors]
    for q in range(0, 100, 20):
        scores = [sum(a * b for a, b in zip(x[q], v)) for v in x]
        order = [i for i in sorted(range(100), key=lambda i: (-scores[i], i)) if i != q][:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(i, scores[i]) for i in order]


def test_topk_fails_openly_where_an_answer_does_not_fit(spark):
    far = spark.createDataFrame([(0, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a score does not fit a long"):
        topk.top_k(far).collect()
    low = spark.createDataFrame([(0, [1e10]), *((i, [-1e200]) for i in range(1, 3))], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a score does not fit a long"):
        topk.top_k(low).collect()
    assert topk.top_k(spark.createDataFrame([(0, [1e200])], "vec_id long, embedding array<double>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, []), (1, [])], "vec_id long, embedding array<double>")).first().score == 0


def test_substring_dedup_of_rows_without_an_id(spark):
    """Rows of no id are one document; each gets the anchors of its own text alone."""
    rng = np.random.default_rng(11)
    shared = " ".join(f"s{i}" for i in range(40))
    own = [" ".join(f"x{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(150)]
    rows = [(None, f"{t} {shared}") for t in own] + [(None, own[0])] * 20 + [(4, f"a b {shared} c"), (9, own[3]), (9, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_spans(df, digest=True).collect())
    assert found == Counter([(None, 100, 0)] * 150 + [(None, 60, 0)] * 20 + [(4, 43, 40), (9, 60, 60), (9, 40, 40)])
    lists = substring.duplicate_spans(df)
    assert {r.doc for r in lists.collect()} == {4, 9}


def test_names_of_blocks_with_a_long_common_beginning(spark):
    """Ranges go by a hash of the whole block: none of them gets all blocks that begin alike."""
    rows = spark.range(4000).select("id", F.concat(F.lit("x" * 600), F.col("id").cast("string")).alias("content")).select(F.col("id").alias("unit"), F.lit(0).alias("pos"), "content")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = [r.name for r in exact_dedup._named(rows, ["content"], "test-names").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(set(names)) == 4000
    held = Counter(n >> 33 for n in names)
    assert len(held) == 4 and max(held.values()) < 1.5 * 1000


def test_id_files_and_packing_take_the_librarys_own_ids(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {1: "<|endoftext|> at the start", 2: "in the <|endoftext|> middle", 3: "at the end <|endoftext|>", 4: "twice<|endoftext|><|endoftext|>", 5: "<|endoftext|>", 6: "none <|endoftex|>"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = {k: [*model.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    assert ids[2][2] == 50256 or 50256 in ids[2]
    start = 0
    for r in sorted(idfile.read(idfile.write(docs, P.path("byte_bpe_50k.json"), P.PATTERN)).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        start += r.n_tokens
    for r in packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
