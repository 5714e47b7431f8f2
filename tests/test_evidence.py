"""Edge cases of the evidence operators: nulls, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import documents as D
from folioflow.operators import relational as R
from folioflow.operators import retrieval as V
from folioflow.operators import rules as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_claims_strip_bullets_and_keep_the_first_of_equal_ones(spark):
    text = "- One claim of some length.\n• ONE  claim of some length.\nshort\nAnother claim of some length!"
    got = D.claims(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("place").collect()
    assert [(r.doc_id, r.claim) for r in got] == [(1, "One claim of some length."), (1, "Another claim of some length!")]


@pytest.mark.parametrize(("claim", "want"), [("a" * 800, "a" * 700), ("a" * 30 + " " + "b" * 700, "a" * 30), ("a" * 5 + " " + "b" * 700, ("a" * 5 + " " + "b" * 700)[:700]), ("x", "x")])
def test_bounded_cuts_at_white_space_unless_little_would_stay(spark, claim, want):
    assert one(spark, T.bounded(F.lit(claim))) == want


@pytest.mark.parametrize(("stages", "want"), [("11111", "A"), ("10111", "A"), ("10110", "B"), ("10100", "C"), ("11000", "D"), ("10000", "E"), ("01111", None), ("1n100", "C")])
def test_safe_grade(spark, stages, want):
    assert one(spark, U.safe_grade(*[F.lit({"1": True, "0": False}.get(c)).cast("boolean") for c in stages])) == want


@pytest.mark.parametrize(("target", "supported", "want"), [(0, 3, 0.45), (3, 0, 0.4), (3, 3, 1.0), (1, 5, 0.72), (4, 5, 0.93), (4, 3, 0.45), (5, 3, 0.18)])
def test_grade_match(spark, target, supported, want):
    assert one(spark, U.grade_match(F.lit(target), F.lit(supported))) == pytest.approx(want)


def test_a_target_above_the_evidence_never_leads(spark):
    score = U.reasoning_score(F.lit(1.0), F.lit(1.0), F.lit(4), F.lit(3), F.lit(1.0), F.lit(1.0))
    assert one(spark, score) == 64.0
    assert one(spark, U.candidate_status(score)) == "review"


def test_period_allowed(spark):
    ok = lambda year, *p: one(spark, U.period_allowed(F.lit(year).cast("int"), F.array(*[F.lit(x) for x in p]).cast("array<string>")))
    assert ok(None) and ok(2020, "2020", "2021-05") and not ok(2020) and not ok(2020, "2019", "2021") and not ok(2020, "soon")


def test_leases_and_overlay(spark):
    jobs = spark.createDataFrame([(1, "running", 1), (2, "running", 9), (3, "cancel_requested", 1), (4, "running", None), (5, "queued", 1)], "id long, status string, until int")
    got = {r.id: r.effective for r in U.leases(jobs, "status", "until", F.lit(5)).collect()}
    assert got == {1: "queued", 2: "running", 3: "cancelled", 4: "running", 5: "queued"}
    units = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, checksum string")
    seen = spark.createDataFrame([(1, "a", "yes"), (2, "x", "yes")], "id long, checksum string, decision string")
    assert {r.id: (r.overlay, r.decision) for r in U.overlay(units, seen, "id").collect()} == {1: ("applied", "yes"), 2: ("stale", None), 3: ("none", None)}


def test_veto_takes_back_only(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "id long, verified boolean")
    verdicts = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, agrees boolean")
    assert {r.id: r.verified for r in U.veto(df, verdicts, "id").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_progress_of_batches(spark):
    rows = [("a", "F"), ("a", "O"), ("b", "P"), ("c", "F"), ("c", "P"), ("d", "F"), ("e", None)]
    got = {r.k: (r.status, r.percentage) for r in U.progress(spark.createDataFrame(rows, "k string, s string"), "k", "s", "F", "P").collect()}
    assert got == {"a": ("running", 50.0), "b": ("failed", 100.0), "c": ("partial", 100.0), "d": ("completed", 100.0), "e": ("queued", 0.0)}


def test_package_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, s double, b boolean")
    assert U.package_score(empty, ["k"], {n: F.col("b") for n in "vwxyz"}, F.col("s")).count() == 0


def test_prefix_join_stops_at_segments(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/bc",), (None,)], "p string")
    folders = spark.createDataFrame([("a/b",), ("a",)], "f string")
    assert sorted((r.p, r.f) for r in R.prefix_join(paths, "p", folders, "f").collect()) == [("a/b/c", "a"), ("a/b/c", "a/b"), ("a/bc", "a")]


def test_largest_remainder():
    assert R.largest_remainder({"a": 40, "b": 36, "c": 12, "d": 12}, 50) == {"a": 20, "b": 18, "c": 6, "d": 6}
    assert R.largest_remainder({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}


def test_renumber_and_first_seen(spark):
    df = spark.createDataFrame([("k", 5, 1), ("k", 5, 2), ("k", 2, 3), ("k", None, 4)], "k string, d int, a int")
    assert sorted((r.a, r["rank"]) for r in R.renumber(df, "k", "d", "a").collect()) == [(1, 2), (3, 1)]
    assert R.first_seen(df, "k", "d", "a", 1).collect()[0]["values"] == [5]


def test_keep_label_and_copies(spark):
    old = spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "k long, v string")
    new = spark.createDataFrame([(1, "n"), (2, "n"), (4, "n")], "k long, v string")
    assert {r.k: r.v for r in R.keep_label(old, new, "k", "v").collect()} == {1: "x", 2: "n", 3: None, 4: "n"}
    df = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u"), (4, None), (5, None)], "k long, t string")
    assert sorted((r.k, r.first_id, r.n_others) for r in R.copies(df, F.sha2("t", 256), "k").collect()) == [(1, 1, 1), (2, 1, 1)]


def test_topic_needs_short_words_to_stand_alone(spark):
    topics = {"x": ("in",), "y": ("making",)}
    assert one(spark, V.topic(F.lit("mining"), topics)) is None
    assert one(spark, V.topic(F.lit("in the making"), topics)) == "x"
    assert one(spark, V.topic(F.lit(None).cast("string"), topics)) is None


def test_small_text_functions(spark):
    assert one(spark, T.title_case(F.lit("the  BIG-house 2"))) == "The Big House 2"
    assert one(spark, T.title_case(F.lit("--"))) is None
    assert one(spark, T.redacted(F.lit("a@b.org 12345678"))) == "[email] [number]"
    assert one(spark, T.last_year(F.lit("1999, 20201 and 2004."))) == "2004"
    assert one(spark, T.last_year(F.lit(None).cast("string"))) is None
    assert one(spark, T.heading(F.lit(" \n\n  Top \nx"))) == "Top"
    assert one(spark, T.heading(F.lit(None).cast("string"))) is None
