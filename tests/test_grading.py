"""Rules and grades: what SQL doesn't state, and edge cases."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from folioflow.operators import grading as G
from folioflow.plans import catalog, grading


def plain_diverse(facts, limit=12):
    facts = sorted(facts, key=lambda f: (-f[3], f[0]))
    chosen = facts[:limit]
    least = max(0.2, facts[0][3] * 0.25)
    for stage in G.STAGES:
        if any(f[1] == stage for f in chosen):
            continue
        new = next((f for f in facts if f[1] == stage and f[2] != "contradictory" and f[3] >= least), None)
        if new is None or new in chosen:
            continue
        if len(chosen) < limit:
            chosen.append(new)
            continue
        count = Counter(f[1] for f in chosen)
        at = next((i for i in range(len(chosen) - 1, -1, -1) if chosen[i][1] not in G.STAGES or count[chosen[i][1]] > 1), None)
        if at is not None:
            chosen[at] = new
    return [f[0] for f in sorted(chosen, key=lambda f: (-f[3], f[0]))]


def test_stage_diverse_equals_a_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    groups = defaultdict(list)
    for k, *fact in grading.facts_of(spark.read.parquet(f"{sf}/orders.parquet").collect()):
        groups[k].append(tuple(fact))
    got = defaultdict(list)
    for r in catalog.queries()["stage_diverse_facts"](spark, sf).orderBy("k", "place").collect():
        got[r.k].append(r.fact_id)
    assert got == {k: plain_diverse(f) for k, f in groups.items()}
    assert any(plain_diverse(f) != [x[0] for x in sorted(f, key=lambda x: (-x[3], x[0]))[:12]] for f in groups.values())


def test_canonical_json_writes_nulls_and_escapes(spark):
    import json

    df = spark.createDataFrame([("a\"b\\c", None, ["y", "x"]), ("é", "1", [])], "b string, a string, c array<string>")
    got = [r.x for r in df.select(G.canonical({"b": F.col("b"), "a": F.col("a"), "c[]": F.col("c")}).alias("x")).collect()]
    want = [{"b": "a\"b\\c", "a": None, "c": ["y", "x"]}, {"b": "é", "a": "1", "c": []}]
    assert got == [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in want]


def test_assessment_of_null_arrays_misses_everything(spark):
    kinds = "k int, stages array<string>, sources array<string>, periods array<string>, organizations array<string>, disqualifiers array<string>"
    full = (1, list(G.STAGES), list(G.PROOF.values()), ["2024"], ["x"], [])
    rows = G.assess(spark.createDataFrame([full, (2, None, None, None, None, None)], kinds), "k")
    assert {(r.k, r.grade): r.passed for r in rows.collect()} == {(k, g): k == 1 for k in (1, 2) for g in G.REQUIRED}
    assert {r.k: r.grade for r in G.passed_grade(rows, "k").collect()} == {1: "A", 2: None}
    assert G.assess(spark.createDataFrame([], kinds), "k").count() == 0


def test_grade_c_needs_e_but_not_d(spark):
    kinds = "k int, stages array<string>, sources array<string>, periods array<string>, organizations array<string>, disqualifiers array<string>"
    stages = ["policy", "implementation"]
    df = spark.createDataFrame([(1, stages, [G.PROOF[s] for s in stages], ["2024"], ["x"], [])], kinds)
    assert {r.grade for r in G.assess(df, "k").where("passed").collect()} == {"E", "C"}
