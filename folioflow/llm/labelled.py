"""The bounded sample of labelled rows that a classifier learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import smallest_hashes


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id, modulo folds; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """text, label double: at most `most` labelled documents that satisfy `learn`.

    The sample is the `most` rows of smallest hash of doc_id, so it is spread evenly over the labels
    and the same in every run; only ids and labels are sorted for it, and at most `most` pairs are
    broadcast. A doc_id that is labelled twice counts once, null labels and ids don't count.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("double").alias("__label"))
        .where(F.col("__id").isNotNull() & F.col("__label").isNotNull())
        .where(learn)
        .groupBy("__id")
        .agg(F.min("__label").alias("__label"))
    )
    chosen = smallest_hashes(usable, usable.count(), most, "__id")
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text")
    return texts.join(F.broadcast(chosen), "__id").select("__id", "text", "__label")
