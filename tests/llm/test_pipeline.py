"""The stages one by one, on the smallest table and against brute force on a fixture."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest

from plumbline.llm.common import table
from tests.llm.test_operators import brute_links, words

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)
BASE = " ".join(f"w{i}" for i in range(60))
CLEAN = [f"The {a} went to the {b} and told the others what it had seen there in the evening, near the old {a} gate." for a in ("miller", "carter", "weaver", "sailor", "baker") for b in ("harbour", "market", "forest", "castle", "island", "village")]
ROWS = [
    (1, "A line that many share.\nown words here and there, enough of them to stay"),
    (2, "a line that many share.\r\nshort\n" + BASE),
    (3, BASE + " tail"),
    (3, "another text of the same id, not at all alike"),
    (4, BASE.replace("w59", "x59")),
    (5, None),
    (6, ""),
    (None, BASE + " tail"),
    (None, "no id here"),
    (8, "in front " + " ".join(f"w{i}" for i in range(20, 45)) + " behind"),
    (8, "in front " + " ".join(f"w{i}" for i in range(20, 45)) + " behind"),
    (9, "two words"),
    (10, "two words"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", None if t is None else len(t), "clash", "clash") for k, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_text string, h string").repartition(3)


def held(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def key(k):
    return -1 if k is None else k


def test_stages_chain(spark):
    docs = table(spark, SF, "documents")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        assert docs.count() <= before, name
        assert docs.where("n_chars <> length(text)").count() == 0
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == before
    total = pieces.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert total <= 1024


@pytest.mark.parametrize("name", [x for x, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, docs, name, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = STAGE[name](spark, docs.limit(0), str(tmp_path))
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_quality_stage_keeps_clean_documents(spark, tmp_path):
    junk = [f"BUY!!! {i} $$$ click >>> {i}{i} !!! win win win" for i in range(30)]
    rows = [(i, t, "clash") for i, t in enumerate(CLEAN + junk)] + [(None, CLEAN[0], "clash"), (100, CLEAN[0] + " And then home.", "clash"), (100, junk[0] + " !!!", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    spark.createDataFrame([(i, int(i < len(CLEAN))) for i in range(len(CLEAN + junk))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = held(STAGE["quality classifier"](spark, docs, str(tmp_path)))
    assert kept == Counter((k, t) for k, t, _ in rows if "BUY" not in t)


def test_line_stage(spark, docs):
    bare = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for k, t in ROWS:
        for x in (t or "").split("\n"):
            holders[bare(x)].add(key(k))
    cut = lambda k, t: "\n".join(x for x in (t or "").split("\n") if len(bare(x)) < 10 or min(holders[bare(x)]) == key(k))
    out = STAGE["line dedup"](spark, docs, SF)
    assert held(out) == Counter((k, cut(k, t)) for k, t in ROWS) and out.columns == docs.columns
    assert out.where("n_chars <> length(text) OR kept_text <> 'clash'").count() == 0


def test_near_duplicate_stage(spark, docs):
    places = {i: t for i, (_, t) in enumerate(sorted(ROWS, key=lambda r: key(r[0])))}
    ids = [k for k, _ in sorted(ROWS, key=lambda r: key(r[0]))]
    want = Counter((ids[i], places[i]) for i, (c, _) in brute_links(places).items() if ids[c] == ids[i])
    assert held(STAGE["n-gram Jaccard join"](spark, docs, SF)) == want and len(ROWS) - sum(want.values()) == 4


def test_substring_stage(spark, docs):
    first = {}
    for k, t in sorted(ROWS, key=lambda r: key(r[0])):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), key(k))

    def cut(k, t):
        w = words(t)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(k) for j in range(i, i + 13)}
        return " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t

    out = STAGE["substring dedup"](spark, docs, SF)
    assert held(out) == Counter((k, cut(k, t)) for k, t in ROWS) and out.columns == docs.columns


def test_packing_stage(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for k, t in ROWS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[k, len(ids), zlib.crc32(ids.tobytes())] += 1
    rows = STAGE["packing"](spark, docs, SF).collect()
    assert Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in rows) == want and len({r.sequence_id for r in rows}) == 1


def test_what_a_stage_returns_goes_to_python_in_small_batches(spark, monkeypatch):
    """Whoever writes a stage's result runs its last step: 1,200 texts of 5,000 bytes were one batch."""
    import pyarrow as pa

    monkeypatch.setattr(corpus_pipeline, "THRESHOLD", 0.0)
    size = lambda batches: (pa.record_batch({"n": [x.num_rows], "size": [x.get_total_buffer_size()]}) for x in batches)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 1200, 1, 1).selectExpr("id AS doc_id", "repeat('elongated ', 500) AS text")
    found = STAGE["quality classifier"](spark, docs, SF).mapInArrow(size, "n long, size long").collect()
    assert sum(x.n for x in found) == 1200 and max(x.n for x in found) <= 300
