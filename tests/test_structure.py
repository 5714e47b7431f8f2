"""Paths of headings against a stack that is folded unit by unit."""

import random

from pyspark.sql import functions as F

from folioflow.operators import structure as S


def test_paths_equal_a_folded_stack(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for doc in range(60):
        stack = []
        for at in range(rng.randrange(0, 40)):
            level = rng.choice([None, None, 1, 2, 3, 5, 9, 12, 0])
            rows.append((doc, at * 3, level, f"t{at % 7}"))
            if level is not None and 1 <= level <= S.LEVELS:
                stack = [*stack[: level - 1], f"t{at % 7}"]
            want[doc, at * 3] = list(stack)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc long, at long, level int, title string, path_ string")
    placed = S.heading_paths(df, "doc", "at", F.col("level"), F.col("title"))
    assert {(r.doc, r.at): r.path for r in placed.collect()} == want and placed.columns == [*df.columns, "path"]
    firsts = {}
    for (doc, at), path in sorted(want.items()):
        if path:
            firsts.setdefault(doc, {}).setdefault(tuple(path), at)
    got = {}
    for r in S.distinct_paths(placed, "doc", "at", 4).orderBy("doc", "place").collect():
        got.setdefault(r.doc, []).append((tuple(r.path), r["first"]))
    assert got == {d: sorted(p.items(), key=lambda x: x[1])[:4] for d, p in firsts.items()}


def test_maps_count_kinds_and_paths(spark):
    rows = [(1, 0, 1, "a", "h"), (1, 1, None, "", "p"), (1, 2, None, "", None), (2, 0, None, "", "p")]
    df = spark.createDataFrame(rows, "doc long, at long, level int, title string, kind string")
    got = {r.doc: (r.n_units, r.kinds, r.n_paths, r.n_regions) for r in S.document_map(S.heading_paths(df, "doc", "at", F.col("level"), F.col("title")), "doc", "at", "kind", F.lit(3_000)).collect()}
    assert got == {1: (3, {"h": 1, "p": 1, "unknown": 1}, 1, 5_000), 2: (1, {"p": 1}, 0, 3_000)}
