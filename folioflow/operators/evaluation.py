"""Evaluation: retrieval metrics against labels, comparison of two candidate sets, feedback terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.relational import ratio


def candidate_sets(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """key, n_left, n_right, n_both, jaccard, coverage (share of left that right has)."""
    a = left.select(key, item).distinct().withColumn("__a", F.lit(True))
    b = right.select(key, item).distinct().withColumn("__b", F.lit(True))
    return compared(a.join(b, [key, item], "full"), key, F.col("__a"), F.col("__b"))


def compared(marked: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """As `candidate_sets`, over rows (key, and each item once) that say whether an item is in either set (null counts as no)."""
    n = lambda c: F.count(F.when(c, 1))
    df = marked.where(F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))).groupBy(key).agg(n(left).alias("n_left"), n(right).alias("n_right"), n(left & right).alias("n_both"), F.count("*").alias("__all"))
    return df.withColumns({"jaccard": ratio(F.col("n_both"), F.col("__all")), "coverage": ratio(F.col("n_both"), F.col("n_left"))}).drop("__all")


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """One row: cases, recall@k and precision@k over the cases of `expected` (key, item); ranked has rank."""
    hits = ranked.where(F.col("rank") <= k).select(key, item).distinct().withColumn("__hit", F.lit(True))
    marked = expected.select(key, item).distinct().withColumn("__want", F.lit(True)).join(hits, [key, item], "full")
    return measures(marked, key, F.col("__hit"), F.col("__want"))


def measures(marked: DataFrame, key: str, hit: Column, wanted: Column) -> DataFrame:
    """As `retrieval_metrics`, over rows (key, and each item once) that say whether an item is shown and whether it is expected (null counts as no)."""
    n = lambda c: F.count(F.when(c, 1))
    per = marked.groupBy(key).agg(n(wanted).alias("__want"), n(wanted & hit).alias("__got"), n(hit).alias("__shown")).where("__want > 0")
    found = F.sum((F.col("__got") > 0).cast("long"))
    return per.agg(F.count("*").alias("cases"), ratio(found, F.count("*")).alias("recall"), ratio(F.sum("__got"), F.coalesce(F.sum("__shown"), F.lit(0))).alias("precision"))


def feedback_terms(terms: DataFrame, positives: DataFrame, least_support: int = 2, least_precision: float = 0.8) -> DataFrame:
    """token, support, observed, precision: terms (doc_id, token) whose documents are positive often enough."""
    marked = terms.distinct().join(positives.select("doc_id").distinct().withColumn("__p", F.lit(1)), "doc_id", "left")
    df = marked.groupBy("token").agg(F.count("__p").alias("support"), F.count("*").alias("observed"))
    return df.withColumn("precision", ratio(F.col("support"), F.col("observed"))).where((F.col("support") >= least_support) & (F.col("precision") >= least_precision))
