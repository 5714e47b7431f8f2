"""Rules as a table: chains, circles and missing grades, and the judgement of changes only."""

import itertools

import pytest
from pyspark.sql import functions as F

from folioflow.operators import grading as G
from folioflow.operators import rulebook as B
from folioflow.session import written

RULES = "p string, grade string, required_stages array<string>, required_sources array<string>, prerequisite string, effective_year int, checksum string, approval_status string, is_compiled boolean"
MAPPINGS = "id long, p string, periods array<string>, organizations array<string>, disqualifiers array<string>"


def rule(p, grade, stages=(), before=None, year=None, status="approved", sources=()):
    return (p, grade, list(stages), list(sources), before, year, f"{p}{grade}{stages}{year}", status, True)


def needs(spark, *rules):
    return {(r.p, r.grade): r.needs for r in B.with_needs(spark.createDataFrame(list(rules), RULES), "p").collect()}


def test_needs_follow_chains_and_end_at_circles_and_gaps(spark):
    got = needs(spark, *[rule("a", g, before=b) for g, b in G.BEFORE.items()], rule("x", "A", before="B"), rule("x", "B", before="C"), rule("x", "C", before="B"), rule("y", "A", before="Z"), rule("y", "B"))
    assert got == {("a", "E"): ["E"], ("a", "D"): ["D", "E"], ("a", "C"): ["C", "E"], ("a", "B"): ["B", "C", "E"], ("a", "A"): ["A", "B", "C", "E"], ("x", "A"): None, ("x", "B"): None, ("x", "C"): None, ("y", "A"): None, ("y", "B"): ["B"]}


def plain(mapping, shown, rules):
    """The chain in the grades' order, one mapping at a time."""
    passed, out = set(), {}
    for g in B.GRADES:
        r = rules[g]
        lacks = [f"stage:{s}" for s in sorted(r[2]) if ("stage", s) not in shown] + [f"source_type:{s}" for s in sorted(r[3]) if ("source_type", s) not in shown]
        if r[4] and r[4] not in passed:
            lacks.append(f"prerequisite_grade:{r[4]}")
        lacks += [f"{n}:required_single" for n, own in (("period", mapping[2]), ("organization", mapping[3])) if len(own or []) != 1]
        if r[5] is not None and not (mapping[2] and min(map(int, mapping[2])) >= r[5]):
            lacks.append("period:before_effective_date")
        lacks += [f"disqualifier:{d}" for d in sorted(set(mapping[4] or []) & set(G.DISQUALIFIERS))]
        out[g] = lacks
        if not lacks:
            passed.add(g)
    return out


@pytest.fixture(scope="module")
def world(spark):
    rules = {p: {g: rule(p, g, G.REQUIRED[g][: 1 + i % 3], G.BEFORE[g], 2021 if p == "q" else None, "approved" if p != "r" or g != "A" else "draft", ["policy_document"] if g == "C" else []) for i, g in enumerate(B.GRADES)} for p in "pqr"}
    mappings, shown = [], {}
    for i, (p, n, years, orgs, flags) in enumerate(itertools.product("pqr", range(6), (["2020"], ["2022"], [], None), (["o"], ["o", "x"]), ([], ["template_only"], None))):
        mappings.append((i, p, years, orgs, flags))
        shown[i] = {("stage", s) for s in G.STAGES[:n]} | ({("source_type", "policy_document")} if i % 2 else set())
    table = B.with_needs(spark.createDataFrame([r for own in rules.values() for r in own.values()], RULES), "p")
    evidence = spark.createDataFrame([(i, *x) for i, own in shown.items() for x in own] * 2, "id long, kind string, name string")
    return mappings, shown, rules, spark.createDataFrame(mappings, MAPPINGS), evidence, written(table, "rules")


def test_assessment_equals_plain_python(world):
    mappings, shown, rules, df, evidence, table = world
    got = {(r.id, r.grade): (r.missing, r.passed) for r in B.assessed(df, evidence, table, "id", "p").collect()}
    want = {(m[0], g): (lacks, not lacks) for m in mappings for g, lacks in plain(m, shown[m[0]], rules[m[1]]).items()}
    assert got == want and sum(ok for _, ok in want.values()) > 50


def test_outcomes_need_every_approval(world):
    mappings, shown, rules, df, evidence, table = world
    got = {r.id: r for r in B.outcomes(B.assessed(df, evidence, table, "id", "p"), table, "id", "p").collect()}
    for m in mappings:
        lacks = plain(m, shown[m[0]], rules[m[1]])
        best = next((g for g in reversed(B.GRADES) if not lacks[g]), None)
        r = got[m[0]]
        assert r.grade == best and r.next_missing == next((x for x in lacks.values() if x), []) and r.primary_allowed == (best is not None and m[1] != "r")


def test_fallbacks_fill_in_and_stay_drafts(spark):
    parameters = spark.createDataFrame([("p",), ("none",)], "p string")
    rules = spark.createDataFrame([rule("p", "A", ["policy"], "B")], RULES).drop("is_compiled")
    got = {(r.p, r.grade): r for r in B.with_fallbacks(parameters, rules, "p").collect()}
    assert len(got) == 10 and got["p", "A"].is_compiled and got["p", "A"].required_stages == ["policy"]
    assert got["none", "C"].required_stages == ["implementation", "policy"] and got["none", "C"].approval_status == "draft" and not got["none", "C"].is_compiled


def test_only_what_changed_is_judged_again(spark, world):
    mappings, _, _, df, evidence, table = world
    none = spark.createDataFrame([], "id long, p string, grade string, next_missing array<string>, approval_status string, primary_allowed boolean, basis string, version int")
    first = written(B.reverified(none, df, evidence, table, "id", "p")[0], "first")
    fresh, kept = B.reverified(first, df, evidence, table, "id", "p")
    assert first.count() == len(mappings) and fresh.count() == 0 and kept.where("is_active").count() == len(mappings)
    # parameter q loses its approval, mapping 0 a fact, mapping 1 goes, one is new
    later = table.withColumn("approval_status", F.when(F.col("p") == "q", "rejected").otherwise(F.col("approval_status")))
    facts = evidence.where("id <> 5")
    now = df.where("id <> 1").union(spark.createDataFrame([(9999, "p", ["2022"], ["o"], [])], MAPPINGS))
    fresh, kept = B.reverified(first, now, facts, later, "id", "p")
    changed = {r.id: r.version for r in fresh.collect()}
    of_q = {m[0] for m in mappings if m[1] == "q"}
    had = {5} if evidence.where("id = 5").count() else set()
    assert set(changed) == of_q | had | {9999} and changed[9999] == 1 and all(v == 2 for k, v in changed.items() if k != 9999)
    assert {r.id for r in kept.where("is_active").collect()} == {m[0] for m in mappings} - of_q - had - {1}
    whole = B.outcomes(B.assessed(now, facts, later, "id", "p"), later, "id", "p").drop("approval_status")
    columns = whole.columns
    active = fresh.select(*columns).union(kept.where("is_active").select(*columns))
    assert sorted(map(str, active.collect())) == sorted(map(str, whole.collect()))


def test_evidence_and_lists_of_facts_are_never_broadcast(spark):
    """Both are a few bytes a mapping as files and many rows as a table, so a broadcast chosen by the file's size would fill the driver."""
    from folioflow.operators import explain as X

    table = B.with_needs(spark.createDataFrame([rule("a", "E", ["policy"], sources=["policy_document"])], RULES), "p")
    df = written(spark.range(100).selectExpr("id", "'a' as p", "array('2021') as periods", "array('x') as organizations", "cast(array() as array<string>) as disqualifiers"), "own")
    evidence = written(spark.range(50).selectExpr("id", "array(named_struct('kind', 'stage', 'name', 'policy'), named_struct('kind', 'source_type', 'name', 'policy_document'), named_struct('kind', 'stage', 'name', null)) as e"), "shown").selectExpr("id", "inline(e)")
    judged = B.assessed(df, evidence, table, "id", "p")
    assert "BroadcastHashJoin [id" not in judged._jdf.queryExecution().executedPlan().toString()
    assert {(r.passed, tuple(r.missing)): r.n for r in judged.groupBy("passed", "missing").agg(F.count("*").alias("n")).collect()} == {(True, ()): 50, (False, ("stage:policy", "source_type:policy_document")): 50}
    lists = written(spark.range(100).selectExpr("id", "transform(sequence(0, 14), i -> concat_ws(':', id, i)) as supporting"), "lists")
    facts = written(spark.range(100).selectExpr("concat_ws(':', id, '3') as fact_id", "'c' as claim"), "facts")
    cited = X.citations(lists, facts, spark.createDataFrame([], "fact_id string, ordinal int, quote string"), "id")
    assert "BroadcastHashJoin [fact_id" not in cited._jdf.queryExecution().executedPlan().toString() and cited.count() == 100


def test_all_tables_of_a_reverification_are_dealt_by_count(spark, world, monkeypatch):
    """An exchange that the planner sizes by bytes puts all mappings, which are short, into one task."""
    mappings, _, _, df, evidence, table = world
    monkeypatch.setattr(B, "MAPPINGS", 100)
    none = spark.createDataFrame([], "id long, p string, grade string, next_missing array<string>, approval_status string, primary_allowed boolean, basis string, version int")
    first = written(B.reverified(none, df, evidence, table, "id", "p")[0], "first")
    fresh, kept = B.reverified(first, df.where("id <> 1"), evidence.where("id <> 5"), table, "id", "p")
    for x in (fresh, kept):
        lines = [y for y in x._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(id#" in y]
        assert lines and all("REPARTITION_BY_NUM" in y and f", {-(-len(mappings) // 100)})" in y for y in lines)
        assert x.rdd.getNumPartitions() == -(-len(mappings) // 100)
    had = {5} if evidence.where("id = 5").count() else set()
    assert {(r.id, r.version) for r in fresh.collect()} == {(i, 2) for i in had}
    assert {r.id for r in kept.where("is_active").collect()} == {m[0] for m in mappings} - had - {1}


def test_mappings_are_made_of_their_own_rows(spark):
    from folioflow.plans import grading as P
    from folioflow.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    df = P._mappings(spark, t)
    assert "Exchange hashpartitioning(doc_id" not in df._jdf.queryExecution().executedPlan().toString()
    hits = G.lexicon_hits(t("documents"), "doc_id", "text", P._terms(spark))
    assert sorted(map(str, df.select("doc_id", F.col("stages").alias("kinds")).collect())) == sorted(map(str, hits.collect()))
