import hashlib
import io
import tarfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import network
from plumbline.session import shared_dir
from plumbline.sources import files


def test_arrays_and_archives(spark):
    one, two = io.BytesIO(), io.BytesIO()
    np.save(one, np.arange(6).reshape(2, 3))
    np.savez(two, a=np.array([1.5]), b=np.array([], float))
    rows = spark.createDataFrame([("x.npy", one.getvalue()), ("y.npz", two.getvalue()), ("none", None), ("empty", b"")], "path string, content binary")
    found = sorted(tuple(r) for r in files.array_values(rows).collect())
    assert found == [*[("x.npy", None, i, float(i)) for i in range(6)], ("y.npz", "a", 0, 1.5)]
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as archive:
        archive.addfile(tarfile.TarInfo("folder/"))
        info = tarfile.TarInfo("folder/n.txt")
        info.size = 3
        archive.addfile(info, io.BytesIO(b"abc"))
    rows = spark.createDataFrame([("t", packed.getvalue()), ("none", None)], "path string, content binary")
    assert [(r.member, r.byte_count) for r in files.archive_members(rows).where("member LIKE '%txt'").collect()] == [("folder/n.txt", 3)]


def test_tree_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"abc")
    (tmp_path / "manifest.json").write_bytes(b"{}")
    found = files.tree_manifest(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("in/a.txt", 3, hashlib.sha256(b"abc").hexdigest())]


def test_canonical_json_does_not_depend_on_the_order_of_columns(spark):
    df = spark.createDataFrame([(1, None, [(2, 3)]), (None, "é", None)], "b int, a string, c array<struct<z:int,y:int>>")
    want = sorted(['{"a":null,"b":1,"c":[{"y":3,"z":2}]}', '{"a":"é","b":null,"c":null}'])
    for columns in (["a", "b", "c"], ["c", "b", "a"]):
        assert sorted(r.json for r in files.canonical_json(df.select(*columns)).collect()) == want


def test_gather_and_product_path(spark):
    wanted = spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, None), (4, 9)], "place int, row_id int")
    values = spark.createDataFrame([(3, "c"), (5, "e")], "row_id int, v string")
    assert [r.v for r in files.gather(wanted, values).orderBy("place").collect()] == ["e", "c", "e"]
    day = F.lit("2024-12-09").cast("date")
    assert spark.range(1).select(files.product_path("b/", day, "pos")).first()[0] == "b/2024/2024-12-09.pos.gz"
    with pytest.raises(ValueError):
        files.product_path("b", day, "x")


def test_velocities_cover_speeds_and_directions(spark):
    v = np.array([r[1:] for r in network.velocity_bank(spark, 256, 50.0, 800.0).orderBy("template").collect()])
    speed = np.linalg.norm(v, axis=1)
    assert speed.min() >= 50 - 1e-9 and speed.max() <= 800 and abs(np.log(speed).mean() - np.log(200)) < 0.05
    assert np.abs((v / speed[:, None]).mean(0)).max() < 0.05


def test_csv_sink_and_its_record(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").coalesce(1)
    record = files.write_csv(df, f"file://{tmp_path}/out").collect()
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv"]
    assert [(r.path, r.byte_count, r.sha256) for r in record if not r.path.startswith(".")] == [(part.name, part.stat().st_size, hashlib.sha256(part.read_bytes()).hexdigest())]
    assert part.read_text().splitlines()[0] == "k,v"
    with pytest.raises(Exception, match="exists"):
        files.write_csv(df, f"file://{tmp_path}/out")


def test_document_and_column_control(spark):
    df = spark.createDataFrame([(2, ("x", [1, 2]))], "b int, a struct<z:string,y:array<int>>")
    assert files.document(df) == '{\n  "a": {\n    "y": [\n      1,\n      2\n    ],\n    "z": "x"\n  },\n  "b": 2\n}\n'
    with pytest.raises(ValueError):
        files.document(df.unionByName(df))
    assert files.select_allowed(df, ["b"], {"discovery": ["b"]}, "discovery").columns == ["b"]
    with pytest.raises(PermissionError, match="a"):
        files.select_allowed(df, ["a"], {"discovery": ["b"]}, "discovery")


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))


def test_contents_leave_in_batches_of_bytes():
    made = []

    def contents():
        for i in range(50):
            made.append(i)
            yield str(i), b"x" * 1000

    sizes = []
    for batch in files.in_bytes(contents(), 4000):
        sizes.append(batch.num_rows)
        assert len(made) == sum(sizes)  # none is made before the ones before it have left
    assert sizes == [4] * 12 + [2]
    assert list(files.in_bytes(iter(()), 4000)) == []


def test_archives_are_packed_on_all_cores(spark):
    from plumbline.plans import feeds

    assert feeds.archives(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
