"""Names of files stay in tables: tasks write, move, list and open files, the driver has counts only."""

import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from folioflow.operators import audit as A
from folioflow.plans import catalog
from folioflow.sources import units

FILES = "name string, content binary"


def kept(folder):
    return {str(x.relative_to(folder)): x.read_bytes() for x in folder.rglob("*") if x.is_file()}


def many(spark, n):
    return spark.range(0, n, 1, 3).select(F.concat(F.col("id") % 4, F.lit("/d/"), "id", F.lit(".txt")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))


def test_tasks_move_the_files_that_they_saved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(units, "MOVES", 40)
    units.register(spark)
    out = tmp_path / "a folder"
    assert units.saved(many(spark, 300), str(out)) == 300
    want = {f"{i % 4}/d/{i}.txt": str(i).encode() for i in range(300)}
    assert kept(out) == want and not [x for x in out.iterdir() if x.name.startswith("_")]
    # A file of that name is replaced, others stay; a null content is empty.
    assert units.saved(spark.createDataFrame([("0/d/0.txt", bytearray(b"new")), ("x", None)], FILES), f"file://{tmp_path}/a%20folder") == 2
    assert kept(out) == want | {"0/d/0.txt": b"new", "x": b""}
    assert units.saved(spark.createDataFrame([], FILES), str(tmp_path / "none")) == 0 and A.listing(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([], FILES).write.format("folioflow_files").mode("overwrite").save(str(tmp_path / "sink"))
    assert kept(tmp_path / "sink") == {} and (tmp_path / "sink").is_dir()


def test_names_that_several_rows_have_or_that_leave_the_folder_save_nothing(spark, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(ValueError, match="one name"):
        units.saved(many(spark, 9).union(many(spark, 1)), str(out))
    for bad in ("../up", "/top", "a//b", "", None):
        with pytest.raises(Exception, match="no name of a file"):
            units.saved(spark.createDataFrame([(bad, bytearray(b"x"))], FILES), str(out))
    assert kept(out) == {} and not list(out.iterdir())


def test_a_file_that_an_earlier_attempt_moved_stays(tmp_path):
    (tmp_path / "held").write_bytes(b"x")
    for _ in range(2):
        units.moved(fs.LocalFileSystem(), str(tmp_path), str(tmp_path / "held"), "a/b", set())
    assert kept(tmp_path) == {"a/b": b"x"}
    with pytest.raises(OSError):
        units.moved(fs.LocalFileSystem(), str(tmp_path), str(tmp_path / "held"), "a/c", set())


def test_a_listing_has_few_parts_for_many_files_and_no_hidden_ones(spark, tmp_path):
    top = tmp_path / "a b"
    for i in range(400):
        (top / f"{i % 3}" / "deep").mkdir(parents=True, exist_ok=True)
        (top / f"{i % 3}" / ("deep" if i % 2 else "") / f"f {i}.txt").write_bytes(b"x" * i)
    (top / "_no").mkdir()
    for hidden in ("_no/x", ".no", "1/_no"):
        (top / hidden).write_bytes(b"no")
    for folder in (str(top), f"file://{tmp_path}/a%20b"):
        found = A.listing(spark, folder)
        # One part for every 32 files before, which were 13, and 25,000 for 770,000.
        assert found.rdd.getNumPartitions() <= 6
        assert sorted(r.length for r in found.collect()) == list(range(400))
        read = A.contents(A.dealt(found)).select("path", "length", F.length("content").alias("n"), "modified").collect()
        assert len(read) == 400 and all(r.length == r.n and r.modified for r in read)
    assert [r.length for r in A.listing(spark, str(top / "1" / "f 4.txt")).collect()] == [4]
    with pytest.raises(Exception, match="FileNotFoundError"):
        A.listing(spark, str(tmp_path / "none"))


def test_files_to_open_are_dealt_by_number_and_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(A, "OPENS", 10)
    monkeypatch.setattr(A, "PART_BYTES", 1_000)
    rows = lambda n, size: spark.range(n).select(F.col("id").cast("string").alias("path"), F.lit(size).cast("long").alias("length"))
    assert [A.dealt(rows(*x)).rdd.getNumPartitions() for x in ((0, 1), (95, 1), (5, 900))] == [1, 10, 5]


def test_the_audit_sends_no_names_to_the_driver(spark, monkeypatch):
    def sink(*_):
        raise AssertionError("the sink's names pass the driver")

    monkeypatch.setattr(units.FilesSink, "writer", sink)
    units.register(spark)
    try:
        got = catalog.queries()["corpus_audit"](spark, "/root/testdata/sf0.001").collect()
    finally:
        monkeypatch.undo()
        units.register(spark)
    n = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert sorted((r.run, r.files) for r in got) == [(1, n), (2, n)]
