"""The full retrieval deals documents once, as texts, and never its pairs; on odd rows it is what its SQL says."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.operators import retrieval as V
from folioflow.plans import catalog

from test_queries import rows

WORDS = "that with from dans nicht best est rest on upon river stone cloud table green seven eleven window garden harbour of the le x 42".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents and items without text, of one word, of one id; phrases whose ends are parts of longer words, and short or wordless ones."""
    folder, rng = tmp_path_factory.mktemp("odd"), random.Random(4)
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, some(rng.randint(3, 9)) + rng.choice([".", "", "! "]) + some(2)) for i in range(1, 25)]
    items += [(25, None), (26, ""), (27, "garden"), (28, "windowgarden"), (29, "est on"), (30, "--- ... !!!! ---"), (31, "River, stone and the harbour "), (32, "best x of the rest"), (33, "window harbour")]
    docs = [(i, rng.choice([some, lambda n: some(n) + ". " + (rng.choice(items)[1] or "")])(rng.randint(0, 40))) for i in range(1, 90)]
    docs += [(90, None), (91, ""), (None, "river stone"), (92, "xriver, STONE and the harbourside"), (93, "newwindow harbours table"), (94, "a windowgardens best"), (95, "rest"), (96, "that best x of the restful from")]
    # Rows of one id, of which some hold a phrase.
    docs += [(97, "river, stone and the harbour that"), (97, None), (97, "with the river, stone and the harbour"), (98, "window harbour"), (98, "that from")]
    labels = [(i, 0 if i % 11 else 1, 0) for i in range(1, 99) if i % 2]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["retrieval_abstentions", "hybrid_full"])
def test_odd_rows_are_as_the_sql_says(spark, odd, name, monkeypatch):
    monkeypatch.setattr(V, "PART_BYTES", 500)
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{odd}/{t}.parquet/*.parquet')")
    df, cursor = catalog.queries()[name](spark, odd), c.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    got, want = rows(df.columns, df.collect()), rows(columns, cursor.fetchall())
    assert got == want and len(want) > 80


def test_a_phrase_may_begin_and_end_in_longer_words(spark):
    texts = spark.createDataFrame([(1, ["xriver, stone of table, harbourside"]), (2, ["stone table, river"]), (3, ["stone harbours", "no", "Stone Harbour"])], "doc_id long, texts array<string>")
    items = spark.createDataFrame([(1, "River, stone of table, harbour"), (2, "stone harbour"), (2, "Stone harbour "), (3, "short"), (4, None)], "item_id long, text string")
    phrases = V.asked(items)
    assert sorted((r.item_id, r.n, r.token) for r in phrases.collect()) == [(1, 1, "stone_table"), (2, 2, None)]
    pairs = texts.select("doc_id").crossJoin(items.select("item_id").distinct()).withColumn("may", F.lit(True))
    assert sorted(tuple(r) for r in V.held(pairs, texts, phrases).where("held > 0").collect()) == [(1, 1, 1), (3, 2, 4)]


@pytest.mark.parametrize("name", ["retrieval_abstentions", "hybrid_full"])
def test_only_texts_are_dealt(spark, odd, name, monkeypatch):
    """No exchange has a row a pair, and the texts are sent once, however many parts of the plan begin with them."""
    monkeypatch.setattr(V, "PART_BYTES", 500)
    df = catalog.queries()[name](spark, odd)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sent = [x for x in text.splitlines() if re.search(r"Exchange (hashpartitioning|rangepartitioning)\(doc_id", x)]
    assert not [x for x in sent if "item_id" in x]
    assert len([x for x in sent if "REPARTITION_BY_NUM" in x and "ReusedExchange" not in x]) == 1
    assert len([x for x in sent if "REPARTITION_BY_NUM" in x]) == 3
