"""Documents are dealt once, into parts that don't grow with the table; what was joined before is a mark on the pairs."""

from pyspark.sql import functions as F

from folioflow.operators import evaluation as E
from folioflow.operators import retrieval as V
from folioflow.plans import catalog

WORDS = "alpha beta gamma delta x of the 7 42 ümlaut"
DATA = "/root/testdata/sf0.001"


def documents(spark, n):
    rows = [(i, " ".join(w for k, w in enumerate(WORDS.split()) if (i >> k) & 1) + (" Alpha-alpha" if i % 5 == 0 else "")) for i in range(n)]
    return spark.createDataFrame([*rows, (1, "alpha delta"), (2, None), (None, "alpha")], "doc_id long, text string")


def items(spark):
    return V.postings(spark.createDataFrame([(1, "alpha beta"), (2, "Beta gamma delta"), (3, "42 omega, alpha alpha")], "item_id long, text string"), "item_id", "text")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_parts_follow_the_bytes_of_text_and_change_nothing(spark, monkeypatch):
    docs = documents(spark, 200)
    few = found(V.lexical(docs, "doc_id", "text", items(spark)))
    monkeypatch.setattr(V, "PART_BYTES", 100)
    assert V.dealt(docs, "doc_id", "text").rdd.getNumPartitions() > 30
    scored = V.lexical(docs, "doc_id", "text", items(spark))
    assert found(scored) == few and few
    # Rows of one id count as one document, and pairs are never dealt again.
    assert sum(1 for r in few if r[0] == 1) == 3 and "hashpartitioning(doc_id#" in plan(scored)
    assert not [x for x in plan(scored).splitlines() if "Exchange hashpartitioning" in x and "doc_id" in x and "item_id" in x]


def test_shares_are_those_of_plain_sets(spark):
    docs, own = documents(spark, 200), {1: {"alpha", "beta"}, 2: {"beta", "gamma", "delta"}, 3: {"42", "omega", "alpha"}}
    words = {}
    for r in docs.where("doc_id is not null").collect():
        words.setdefault(r.doc_id, set()).update(w for w in (r.text or "").lower().replace("-", " ").replace("ü", " ").split() if len(w) > 1 and w not in ("of", "the"))
    want = sorted((d, i, len(w & s), round(len(w & s) / min(len(w), len(s)), 6)) for d, w in words.items() for i, s in own.items() if w & s)
    assert found(V.overlap(docs, "doc_id", "text", items(spark))) == want
    assert found(V.lexical(docs, "doc_id", "text", items(spark)).select("doc_id", "item_id", "share")) == [(d, i, s) for d, i, _, s in want]


def test_terms_of_feedback_are_not_dealt_as_rows(spark):
    text = plan(catalog.queries()["feedback_points"](spark, DATA))
    assert not [x for x in text.splitlines() if "Exchange hashpartitioning(doc_id" in x and "token" in x]


def test_pairs_of_shadow_and_gold_are_made_once(spark):
    for name in ("shadow_jaccard", "gold_metrics", "mapping_scores", "candidate_expansion"):
        text = plan(catalog.queries()[name](spark, DATA))
        assert text.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in text, name


def test_marks_say_what_joined_sets_say(spark):
    rows = [(k, i, (k * i) % 3 == 0, (k + i) % 2 == 0 if i else None) for k in range(6) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, i int, a boolean, b boolean")
    a, b = df.where("a"), df.where("b").withColumn("rank", F.lit(1))
    assert found(E.compared(df, "k", F.col("a"), F.col("b"))) == found(E.candidate_sets(a, b, "k", "i"))
    assert found(E.measures(df, "k", F.col("b"), F.col("a"))) == found(E.retrieval_metrics(b, a, "k", "i", 1))


def greedy(own, k, cap, wide):
    """The choice of one document's (rank, item, group, wider), one candidate at a time."""
    if len(own) <= k:
        return [i for _, i, _, _ in own]
    take, skip = [], []
    for x in own:
        fits = len(take) < k and sum(y[2] == x[2] for y in take) < cap and sum(y[3] == x[3] for y in take) < wide
        (take if fits else skip).append(x)
    return [i for _, i, _, _ in (take + skip)[:k]]


def test_diverse_gathers_few_candidates_and_chooses_as_before(spark):
    import random

    rng, k, cap, wide = random.Random(5), 6, 2, 3
    own = {d: [(3 * r + 1, 1000 - r, rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y", None])) for r in range(n)] for d, n in enumerate((1, 6, 7, 12, 40, 90, 200))}
    own[7] = [(r, r, "a", "x") for r in range(1, 100)] + [(r, r, "b", "y") for r in range(100, 103)]
    df = spark.createDataFrame([(d, *x) for d, rows in own.items() for x in rows], "doc_id long, rank int, item_id long, kind string, wider string")
    picked = V.diverse(df, k, "kind", share=0.25, wider="wider")
    got = {}
    for r in picked.orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append(r.item_id)
    assert got == {d: greedy(rows, k, cap, wide) for d, rows in own.items()}
    # Choices need not all candidates of a document in one row.
    gathered = plan(picked)
    assert "row_number" in gathered and gathered.index("collect_list") < gathered.index("row_number")


def test_texts_are_dealt_not_their_runs(spark):
    """A task that deals holds what it sends; runs are three times their text."""
    text = plan(V.dealt(documents(spark, 50), "doc_id", "text"))
    assert "regexp_extract_all" not in text[text.index("REPARTITION_BY_NUM") :]
    got = {r.doc_id: r.runs for r in V.dealt(spark.createDataFrame([(1, "ab"), (1, "cd x"), (2, None), (1, None)], "doc_id long, text string"), "doc_id", "text").collect()}
    assert sorted(got[1]) == ["ab", "cd"] and got[2] == []
