"""Digest trees, restores of single leaves, and audits that open only what is new."""

import os

from pyspark.sql import functions as F

from folioflow.operators import audit as A
from folioflow.operators import backup as B
from folioflow.session import written

ROWS = "k long, s string, x double"


def table(spark, change=None, drop=(), more=()):
    rows = [(k, None if k % 5 == 0 else f"s{k % 3}", k / 3) for k in range(900) if k not in drop] + list(more)
    return spark.createDataFrame([(k, "changed", x) if k == change else (k, s, x) for k, s, x in rows], ROWS)


def trees(df, levels=3):
    return written(B.tree(B.with_leaf(df, ["k"], levels), levels), "tree")


def test_equal_tables_have_equal_trees_in_any_order(spark):
    a, b = trees(table(spark)), trees(table(spark).repartition(7, "x"))
    assert B.damaged(a, b, 3).count() == 0 and a.where("level = 0").first().n == 900 and a.where("level = 3").count() > 300


def test_one_flip_is_found_in_its_leaf_alone(spark):
    whole, live = table(spark), table(spark, change=17, drop={40}, more=[(5000, "x", 1.0)])
    leaves = {r.k: r[B.LEAF] for r in B.with_leaf(live.union(whole), ["k"], 3).collect()}
    got = B.damaged(trees(live), trees(whole), 3).collect()
    assert {r.node for r in got} == {leaves[17], leaves[40], leaves[5000]}
    d = B.differences(*[B.with_leaf(x, ["k"], 3) for x in (live, whole)], B.damaged(trees(live), trees(whole), 3), ["k"])
    assert {(r.k, r.state) for r in d.collect()} == {(17, "changed"), (40, "missing"), (5000, "extra")}


def test_nulls_and_repeats_count(spark):
    one = spark.createDataFrame([(1, None, 1.0)], ROWS)
    other = spark.createDataFrame([(1, "null", 1.0)], ROWS)
    assert B.damaged(trees(one), trees(other), 3).count() == 1 and B.damaged(trees(one.union(one)), trees(one), 3).count() == 1
    none = spark.createDataFrame([], ROWS)
    assert trees(none).count() == 0 and B.damaged(trees(none), trees(one), 3).count() == 1


def test_a_restore_writes_damaged_leaves_only(spark, tmp_path):
    live, backup = str(tmp_path / "live"), str(tmp_path / "backup")
    B.write(table(spark), backup, ["k"], 2)
    B.write(table(spark, change=17, more=[(5000, "x", 1.0)]), live, ["k"], 2)
    assert B.verify(spark, live, 2).count() == 0
    stamp = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "live" / "rows").rglob("*.parquet")}
    before = stamp()
    leaves = [r.node for r in B.damaged(spark.read.parquet(f"{live}/tree"), spark.read.parquet(f"{backup}/tree"), 2).collect()]
    B.restore(spark, live, backup, leaves)
    assert len(set(before.items()) - set(stamp().items())) == len(leaves) <= 2
    assert B.damaged(written(B.tree(B.read(spark, live), 2), "t"), spark.read.parquet(f"{backup}/tree"), 2).count() == 0
    assert B.verify(spark, live, 2).count() == len(leaves)  # the tree beside it is still the old one
    assert B.levels_for(10) == 1 and B.levels_for(50_000 * 64) == 2 and B.levels_for(10**15) == B.MOST_LEVELS


def test_a_leaf_that_the_backup_lacks_becomes_empty(spark, tmp_path):
    live, backup = str(tmp_path / "live"), str(tmp_path / "backup")
    B.write(table(spark).where("k < 3"), backup, ["k"], 2)
    B.write(table(spark).where("k < 9"), live, ["k"], 2)
    leaves = [r.node for r in B.damaged(spark.read.parquet(f"{live}/tree"), spark.read.parquet(f"{backup}/tree"), 2).collect()]
    B.restore(spark, live, backup, leaves)
    assert sorted(r.k for r in B.read(spark, live).collect()) == [0, 1, 2]


def engine(rows):
    return rows.select("sha256", F.length("content").cast("long").alias("size"))


def test_a_second_audit_opens_no_unchanged_file(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(6):
        (folder / f"f{i}.txt").write_bytes(b"x" * (i // 2 + 1))
    manifest, results = spark.createDataFrame([], A.MANIFEST), spark.createDataFrame([], "sha256 string, version string, size long")
    manifest, results, seen = A.audited(A.listing(spark, str(folder)), manifest, results, "v1", engine)
    assert seen.get == {"opened": 6, "bytes": 12} and results.count() == 3
    total = lambda m, r, v="v1": A.corpus(m, r, v).agg(F.count("*"), F.sum("size")).first()
    assert tuple(total(manifest, results)) == (6, 12)
    # nothing changed: nothing is opened, the totals are the same
    manifest, results, seen = A.audited(A.listing(spark, str(folder)), manifest, results, "v1", engine)
    assert seen.get == {"opened": 0, "bytes": 0} and tuple(total(manifest, results)) == (6, 12)
    # a changed file is opened, a known content isn't judged again, a lost file leaves the corpus
    (folder / "f0.txt").write_bytes(b"xx")
    os.utime(folder / "f0.txt", (1, 1))
    (folder / "f5.txt").unlink()
    manifest, results, seen = A.audited(A.listing(spark, str(folder)), manifest, results, "v1", engine)
    assert seen.get == {"opened": 1, "bytes": 2} and results.count() == 3 and tuple(total(manifest, results)) == (5, 10)
    # another version of the engine judges each content once, without opening files for their digests
    manifest, results, seen = A.audited(A.listing(spark, str(folder)), manifest, results, "v2", engine)
    assert seen.get["opened"] == 0 and results.where("version = 'v2'").count() == 3 and tuple(total(manifest, results, "v2")) == (5, 10)
