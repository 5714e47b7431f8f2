"""Structure of documents from the order of their units: paths of headings, regions, and one map of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels that a heading can have, and what a document's map lists at most.
LEVELS, MOST_PATHS, MOST_REGIONS = 9, 500, 5_000


def heading_paths(units: DataFrame, doc: str, order: str, level: Column, title: Column) -> DataFrame:
    """units with path, the titles of the headings that a unit stands under, its own included.

    A heading of level n leaves at most n - 1 of the headings that stand so far and comes after them; level is null
    for other units, and order is unique within doc. No list is gathered: how deep a heading comes is a running minimum,
    as depth = min(level, depth before + 1), and the heading of each depth is the last one that no shallower one has cut off.
    """
    w = Window.partitionBy(doc).orderBy(order)
    own = F.when(level.between(1, LEVELS), level)
    df = units.withColumns({"__level": own, "__title": F.when(own.isNotNull(), title)})
    df = df.withColumn("__n", F.count("__level").over(w))
    df = df.withColumn("__low", F.min(F.col("__level") - F.col("__n")).over(w))
    df = df.withColumn("__depth", F.when(F.col("__level").isNotNull(), F.col("__n") + F.least(F.lit(0), F.col("__low"))))
    last = {f"__h{k}": F.last(F.when(F.col("__depth") == k, F.struct(F.col(order).alias("at"), F.col("__title").alias("title"))), ignorenulls=True).over(w) for k in range(1, LEVELS + 1)}
    cut = {f"__c{k}": F.last(F.when(F.col("__depth") < k, F.col(order)), ignorenulls=True).over(w) for k in range(2, LEVELS + 1)}
    df = df.withColumns(last | cut)
    stands = lambda k: F.when(F.lit(True) if k == 1 else F.col(f"__h{k}.at") > F.col(f"__c{k}"), F.col(f"__h{k}.title"))
    path = F.array_compact(F.array(*[stands(k) for k in range(1, LEVELS + 1)]))
    return df.select(*units.columns, path.alias("path"))


def distinct_paths(placed: DataFrame, doc: str, order: str, most: int = MOST_PATHS) -> DataFrame:
    """doc, place, path, first: the first `most` distinct paths of each document by the unit that they first occur at; empty paths are left out."""
    first = placed.where(F.size("path") > 0).groupBy(doc, "path").agg(F.min(order).alias("first"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("first")))
    return ranked.where(F.col("place") <= most).select(doc, "place", "path", "first")


def document_map(placed: DataFrame, doc: str, order: str, kind: str, regions: Column | None = None) -> DataFrame:
    """doc, n_units, kinds (counts by kind), n_paths, n_regions: one row a document; paths and regions are counted as far as a map lists them.

    Kinds and paths are summed up by their own keys first, so a long document isn't gathered.
    """
    count = F.coalesce(regions, F.lit(0)) if regions is not None else F.lit(0)
    by_kind = placed.groupBy(doc, F.coalesce(F.col(kind), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), F.sum(count).alias("regions"))
    pairs = F.sort_array(F.collect_list(F.struct("kind", "n")))
    whole = by_kind.groupBy(doc).agg(F.sum("n").alias("n_units"), F.map_from_entries(pairs).alias("kinds"), F.least(F.sum("regions"), F.lit(MOST_REGIONS)).cast("long").alias("n_regions"))
    paths = placed.where(F.size("path") > 0).select(doc, "path").distinct().groupBy(doc).agg(F.least(F.count("*"), F.lit(MOST_PATHS)).cast("long").alias("n_paths"))
    return whole.join(paths, doc, "left").select(doc, "n_units", "kinds", F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "n_regions")
