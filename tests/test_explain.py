"""Citations, checks and roles, with lists longer than a row shows, gaps and nothing at all."""

from pyspark.sql import functions as F

from folioflow.operators import explain as X


def test_citations_keep_the_lists_order_and_its_bounds(spark):
    mappings = spark.createDataFrame([(1, [f"f{k}" for k in (5, 99, 3)]), (2, [f"f{k}" for k in range(40, 0, -1)]), (3, []), (4, None)], "id long, supporting array<string>")
    facts = spark.createDataFrame([(f"f{k}", f"claim {k}") for k in range(1, 30)], "fact_id string, claim string")
    sources = spark.createDataFrame([(f"f{k}", n, f"q{n}") for k in (3, 29) for n in range(9, 0, -1)], "fact_id string, ordinal int, quote string")
    got = {r.id: r.citations for r in X.citations(mappings, facts, sources, "id").collect()}
    assert [(c.fact_id, c.claim, c.quotes) for c in got[1]] == [("f5", "claim 5", []), ("f3", "claim 3", ["q1", "q2", "q3", "q4", "q5"])]
    assert [c.fact_id for c in got[2]] == [f"f{k}" for k in range(29, 17, -1)] and set(got) == {1, 2}


def test_a_mapping_is_verified_if_all_its_checks_are(spark):
    checks = [(1, 1, "verified", ["b"]), (1, 0, "verified", ["a", "a2"]), (2, 0, "verified", None), (2, 1, None, []), (3, 0, "verified", [f"w{k}" for k in range(30)])]
    got = {r.id: (r.verified, r.warnings) for r in X.checked(spark.createDataFrame(checks, "id long, ordinal int, status string, findings array<string>"), "id").collect()}
    assert got == {1: (True, ["a", "a2", "b"]), 2: (False, []), 3: (True, [f"w{k}" for k in range(20)])}


def test_without_checks_a_person_has_to_look(spark):
    mappings = spark.createDataFrame([(1, ["f"]), (2, [])], "id long, supporting array<string>")
    outcomes = spark.createDataFrame([(1, "A")], "id long, grade string")
    checks = spark.createDataFrame([(1, 0, "verified", [])], "id long, ordinal int, status string, findings array<string>")
    facts, sources = spark.createDataFrame([("f", "c")], "fact_id string, claim string"), spark.createDataFrame([], "fact_id string, ordinal int, quote string")
    got = {r.id: (r.grade, r.verification_status, len(r.citations), r.warnings) for r in X.explained(mappings, outcomes, checks, facts, sources, "id").collect()}
    assert got == {1: ("A", "verified", 1, []), 2: (None, "needs_human_review", 0, [])}


def test_roles_are_inferred_and_never_promoted(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "Memo of May.txt"), (3, "b"), (4, None), (5, "memorial"), (6, "c")], "id long, name string")
    facts = spark.createDataFrame([(1, "evaluation", "primary"), (3, "policy", None), (4, "other", "context"), (5, None, None), (2, "policy", "primary")], "id long, fact_type string, role string")
    got = {r.id: r.role for r in X.inferred_roles(docs, facts, spark.createDataFrame([("memo",)], "term string"), "id", "name").collect()}
    assert got == {1: "primary", 2: "supporting", 3: "supporting", 4: "context", 5: "context", 6: "not_evidence"}
    pairs = [(a, b) for a in X.ROLES for b in (*X.ROLES, "other", None)]
    for r in spark.createDataFrame(pairs, "a string, b string").withColumn("x", X.conservative(F.col("a"), F.col("b"))).collect():
        assert r.x == (min(r.a, r.b, key=X.ROLES.index) if r.b in X.ROLES else r.a)
