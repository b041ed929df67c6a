"""Decontamination, importance resampling and alignment of vocabularies, against brute force on small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from plumbline.llm import alignment, decontaminate, importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"long{i % 37}" for i in range(20_000))
ITEM = "What IS the answer, to: one two three four five six seven?"
TEXTS = [
    (1, f"Before. {ITEM} After"), (2, "before what-is THE answer to one\ntwo three four five six seven after all"), (3, "the answer to one two three four five six"),
    (4, None), (5, ""), (6, " .,!? "), (7, "Ünïcode ÀÉ wörds — short item here. 日本語 x"), (8, LONG), (None, "short item"), (9, "short ITEM short item"), (9, "short ITEM short item"),
    (10, "a\x00b\tc\x7fd ẞ İ " * 8), (11, "z" * 5000 + " short " + "é" * 3000 + " item"),
]
BENCH = [(1, ITEM), (2, "Short; item"), (2, "wörds SHORT"), (3, None), (4, "..."), (5, "no such words anywhere at all in these documents now"), (10, LONG[:400]), (None, "日本語"), (6, "short item")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "own", "x", k) for k, t in TEXTS], "doc_id long, text string, items string, hits string, weight long").repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def hit_words(text, size):
    own, hit, items = words(text), set(), set()
    for item, t in BENCH:
        w = words(t)
        for i in range(max(1, len(w) - size + 1)) if w else []:
            win = w[i : i + size]
            for j in range(len(own) - len(win) + 1):
                if own[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    items.update([] if item is None else [str(item)])
    return own, hit, sorted(items)


@pytest.mark.parametrize("part_bytes", [1 << 22, 300])
def test_decontamination_against_brute_force(docs, bench, part_bytes):
    found = decontaminate.scan(docs, bench, part_bytes=part_bytes).collect()
    want = Counter()
    for k, t in TEXTS:
        own, hit, items = hit_words(t, 10)
        want[k, t, len(own), len(hit), tuple(items)] += 1
    assert Counter((r.doc_id, r.text, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == want
    for r in found:  # offsets are the original's
        spans = [r.text[h.start : h.stop] for h in r.hits]
        assert sum(len(words(s)) for s in spans) == r.n_hit and all(words(s[:1]) and words(s[-1:]) for s in spans)
    assert next(r for r in found if r.doc_id == 1).hits[0].asDict() == {"start": 8, "stop": 8 + len(ITEM) - 1}
    assert {r.weight for r in found} == {k for k, _ in TEXTS}  # other columns stay


def test_decontamination_digest_and_empty_tables(docs, bench):
    found = decontaminate.digest(docs, bench).collect()
    want = Counter()
    for k, t in TEXTS:
        own, hit, items = hit_words(t, 10)
        want[k, len(own), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(map(tuple, found)) == want
    assert decontaminate.digest(docs.limit(0), bench).count() == 0
    assert decontaminate.digest(docs, bench.limit(0)).where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def features(text, most):
    own = words(text)
    return [" ".join(own[i : i + n]).encode() for n in range(1, most + 1) for i in range(len(own) - n + 1)]


@pytest.mark.parametrize("most", [1, 3])
def test_importance_against_brute_force(docs, bench, most):
    buckets = 50
    found = importance.resample(docs, bench, percent=50, least_words=3, buckets=buckets, most=most, seed=7).collect()
    count = lambda texts: np.bincount([zlib.crc32(x) % buckets for t in texts for x in features(t, most)], minlength=buckets)
    s, t = count([x for _, x in TEXTS]), count([x for _, x in BENCH])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for k, x in TEXTS:
        weight = sum(gain[zlib.crc32(f) % buckets] for f in features(x, most))
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(features(x, most)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= 3), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = len(able) // 2
    want = Counter([(*r[:4], i + 1) for i, r in enumerate(able[:drawn])] + [(*r[:4], None) for r in able[drawn:]] + [(*r[:4], None) for r in rows if r[4] < 3])
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found) == want


def test_importance_of_empty_tables_and_many_equal_rows(spark, docs, bench):
    assert importance.resample(docs.limit(0), bench).count() == 0
    assert importance.resample(docs, bench.limit(0)).count() == len(TEXTS)
    text = " ".join(f"w{i}" for i in range(25))
    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    found = importance.resample(rows, bench).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 201)) and len({r.score for r in found}) == 1


def test_crcs_advance_together():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    length = np.concatenate([rng.integers(1, 12, 296), [700, 900, 1, 64]])
    state = importance.advance(np.full(300, 0xFFFFFFFF, np.uint32), data, start, length) ^ np.uint32(0xFFFFFFFF)
    assert state.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, length)]


ODD = ["a▁b", "<s> x </s> <0x41> <unk>", "  two  spaces \n\n tab\t x", "日本語 テスト😀", "it's (fine); don't, really... e.g. x.com/path?a=b&c=[1,2,3]\r\n", "<|endoftext|> y", "\x00 nul", "ﬁ①Å ́x", " lead", "trail ", "\n",
       'word_word-word, "quoted" \'single\' 12,345.67', "a!\x1c b \x1c\n!", "x\r\n\r\n y \t\t z\t", "　x　\n y​ z\x85", "", None, "same text twice", "same text twice", LONG]


def plain_alignment(texts):
    """Whole texts by the two libraries, and every pair of tokens compared by their ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_model.encode_special_tokens = True
    to_byte = {c: i for i, c in enumerate(alignment.bpe.byte_chars())}
    out, counts = [], Counter()
    for t in texts:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        raw_a = [bytes(to_byte[c] for c in a_model.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        if t and not b"".join(raw_a) == b"".join(raw_b) == f" {t}".encode():
            a, b, raw_a, raw_b = [], [], [], []
        ends_a, ends_b = np.cumsum([0, *map(len, raw_a)])[1:].tolist(), np.cumsum([0, *map(len, raw_b)])[1:].tolist()
        place_b = {e: j for j, e in enumerate(ends_b)}
        links = [(a[i], b[place_b[e]]) for i, e in enumerate(ends_a) if e in place_b]
        counts.update(links)
        groups, i, j = [], 0, 0
        for k, e in enumerate(ends_a):
            if e in place_b:
                groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : place_b[e] + 1])))
                i, j = k + 1, place_b[e] + 1
        out.append((len(a), len(b), links, groups))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(x, y, len(g), len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for x, y, l, g in out], counts


def test_alignment_against_whole_texts(spark):
    want, _ = plain_alignment(ODD)
    docs = spark.createDataFrame([(None if i == 3 else i, t, "own") for i, t in enumerate(ODD)], "doc_id long, text string, links string").repartition(3)
    found = alignment.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()
    assert Counter(map(tuple, found)) == Counter((None if i == 3 else i, *w) for i, w in enumerate(want))
    assert sum(w[0] == 0 for w in want) >= 3 and want[-1][0] > 20_000
    assert alignment.align(docs.limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0


def test_alignment_counts_in_shards(spark, monkeypatch):
    """Small partial counts and many shards; the table of all pairs is the plain counts."""
    texts = [t for t in ODD if t != LONG] * 3
    _, counts = plain_alignment(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = alignment.aligned(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    partial = alignment.partial_counts(found, held=16)
    assert partial.groupBy("key").sum("n").count() == len(counts)
    folder, shards = alignment.count_shards(found)
    got = {(r.a, r.b): r.n for r in alignment.pair_counts(spark, folder, shards).collect()}
    assert got == dict(counts)
    rows = shards.orderBy("low").collect()
    assert all(x.high < y.low for x, y in zip(rows, rows[1:])) and sum(r.n for r in rows) == len(counts)
    held = alignment.Counts(folder, [r.shard for r in rows], [r.low for r in rows])
    keys = np.sort(np.array([b << 32 | a for a, b in counts] + [1, 5 << 40], np.int64))
    assert held.of(keys).tolist() == [counts.get((k & 0xFFFFFFFF, k >> 32), 0) for k in keys.tolist()]


def test_a_vocabulary_that_reaches_over_spaces_is_encoded_whole():
    assert alignment.parts_at_spaces(["▁the", "▁▁", "x", "e."]) and not alignment.parts_at_spaces(["of▁the"]) and not alignment.parts_at_spaces([")\n"])
    path = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    texts = ["some words, and  spaces \n here", "it's\tso"]
    whole = alignment.Aligner(*path)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path[1])
    whole.chunks, whole.encode_b = (lambda t: [t]), (lambda chunks: model.encode([x[1:] for x in chunks], out_type=int))
    assert whole(texts) == alignment.Aligner(*path)(texts)


def test_a_task_gives_its_memory_back_after_its_last_batch(monkeypatch):
    import pyarrow as pa

    from plumbline.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batches = [pa.record_batch({"text": ["ab", "c"]}), pa.record_batch({"text": ["d"]})]
    assert sum(b.num_rows for b in common.slices(iter(batches))) == 3 and given == [1]
    monkeypatch.undo()
    common.give_back()


def test_a_worker_keeps_the_words_of_one_operator():
    from plumbline.llm import bpe, grams

    coder = bpe.library_coder(P.path("byte_bpe_50k.json"), P.PATTERN)
    before = coder(["some words"])
    assert bpe.library_coder.cache_info().currsize
    hashes, _ = grams.word_hashes(["some words"])
    assert not bpe.library_coder.cache_info().currsize and len(grams._known) >= 2
    assert bpe.library_coder(P.path("byte_bpe_50k.json"), P.PATTERN)(["some words"]) == before and not grams._known
    assert (grams.word_hashes(["some words"])[0] == hashes).all()
