"""Relational core: latest rows, rollups, ratios, quotas, margins, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in `order`, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rollup(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, zero where the whole is."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)


def share_where(df: DataFrame, condition: Column, *keys: str) -> DataFrame:
    """n, hits and their ratio for each key; a null condition counts as false."""
    hits = F.coalesce(F.sum(condition.cast("long")), F.lit(0))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), hits.alias("hits")).withColumn("ratio", ratio(F.col("hits"), F.col("n")))


def margin(df: DataFrame, key: str, score: str) -> DataFrame:
    """Best and second-best score of each key and the gap between them (the best itself where it is alone)."""
    w = Window.partitionBy(key).orderBy(F.desc(score))
    ranked = df.withColumns({"__n": F.row_number().over(w), "__next": F.lead(score).over(w)}).where("__n = 1")
    return ranked.select(key, F.col(score).alias("top1"), F.col("__next").alias("top2"), F.round(F.col(score) - F.coalesce("__next", F.lit(0.0)), 4).alias("margin"))


def quotas(df: DataFrame, kind: str, quota: Mapping[str, int], total: int, *order: Column) -> DataFrame:
    """Up to quota rows of each kind in `order`, then the best of the rest until there are `total`; the feature is a sample."""
    w = Window.partitionBy(kind).orderBy(*order)
    of_kind = F.coalesce(*[F.when(F.col(kind) == k, F.lit(n)) for k, n in quota.items()], F.lit(0))
    ranked = df.withColumn("__n", F.row_number().over(w)).withColumn("backfill", F.col("__n") > of_kind)
    return ranked.orderBy("backfill", *order).limit(total).drop("__n")


def duplicate_groups(df: DataFrame, digest: Column, id_: str) -> DataFrame:
    """Groups of two rows or more of equal digest: count and smallest id; ids aren't gathered."""
    return df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).where("n > 1")


def duplicate_verdicts(df: DataFrame, id_: str, digest: str, name: str, size: str) -> DataFrame:
    """id, verdict: exact (another row has the digest), high (name and size), possible (name), clear. Groups are counted first, so a hot one costs a row."""

    def counted(keys: list[str], flag: str, rows: DataFrame) -> DataFrame:
        many = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
        own = many.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias(flag))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        on = same[0]
        for x in same[1:]:
            on = on & x
        return rows.join(own, on, "left").drop(*[f"__{k}" for k in keys])

    out = counted([name], "__c", counted([name, size], "__b", counted([digest], "__a", df)))
    return out.select(id_, F.when(F.col("__a"), "exact").when(F.col("__b"), "high").when(F.col("__c"), "possible").otherwise("clear").alias("verdict"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of both, the highest version of each key; the new row wins a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, keys, F.desc(version), F.desc("__new")).drop("__new")


def removed(existing: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows whose key isn't expected any more."""
    return existing.join(expected.select(*keys).distinct(), list(keys), "left_anti")


def versions(df: DataFrame, keys: Sequence[str], id_: str) -> DataFrame:
    """Ledger with supersedes (the id before it of its key) and is_active (the last of its key)."""
    w = Window.partitionBy(*keys).orderBy(id_)
    return df.withColumns({"supersedes": F.lag(id_).over(w), "is_active": F.lead(id_).over(w).isNull()})


def weighted_mean(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), 6).alias("weighted_mean"))


def dominant(df: DataFrame, key: str, value: str, share: float, least: int = 2) -> DataFrame:
    """The most frequent value of each key if it occurs `least` times and in `share` of its rows; the smaller value wins a tie."""
    w = Window.partitionBy(key)
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(w))
    return latest(counts, [key], F.desc("n"), F.asc(value)).where((F.col("n") >= least) & (F.col("n") >= share * F.col("total")))


def keep_label(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """Full outer merge on a key that is unique on both sides: an old label stays unless it is null or blank."""
    a = old.select(key, F.col(label).alias("__old"))
    b = new.select(key, F.col(label).alias("__new"))
    kept = F.when(F.length(F.trim(F.coalesce("__old", F.lit("")))) > 0, F.col("__old")).otherwise(F.col("__new"))
    return a.join(b, key, "full").select(key, kept.alias(label))


def manifest(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """table_name, n_rows, key_sum for each table and its integer key; equal manifests are what a copy is checked by."""
    rows = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col(key).cast("long")), F.lit(0)).alias("key_sum")) for name, (df, key) in tables.items()]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


def manifest_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """table_name, state of two manifests: same, changed, missing (not found) or extra (not expected)."""
    own = lambda df, p: df.select("table_name", F.col("n_rows").alias(f"{p}n"), F.col("key_sum").alias(f"{p}s"))
    same = (F.col("an") == F.col("bn")) & (F.col("as") == F.col("bs"))
    state = F.when(F.col("an").isNull(), "extra").when(F.col("bn").isNull(), "missing").when(same, "same").otherwise("changed")
    return own(expected, "a").join(own(found, "b"), "table_name", "full").select("table_name", state.alias("state"))


def copies(df: DataFrame, digest: Column, id_: str) -> DataFrame:
    """Rows whose digest another row has too: id, first_id of the digest, n_others. Pairs are never made."""
    keyed = df.select(id_, digest.alias("__digest"))
    groups = duplicate_groups(keyed, F.col("__digest"), id_).withColumnRenamed("digest", "__digest")
    return keyed.join(groups, "__digest").select(id_, "first_id", (F.col("n") - 1).alias("n_others"))


def prefix_join(paths: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows of both where prefix is path or a folder above it.

    Every path gives its own prefixes at `/`, and these meet the other table by equality, so no
    pair is compared that doesn't match.
    """
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.withColumn("__prefix", F.explode(own)).join(prefixes, F.col("__prefix") == F.col(prefix)).drop("__prefix")


def largest_remainder(weights: Mapping[str, int], total: int) -> dict[str, int]:
    """Whole shares of total in proportion to the weights; what rounding leaves goes to the largest remainders, first named first."""
    every = sum(weights.values())
    shares = {k: total * w // every for k, w in weights.items()}
    order = sorted(weights, key=lambda k: -(total * weights[k] % every))
    return {k: n + (k in order[: total - sum(shares.values())]) for k, n in shares.items()}


def renumber(df: DataFrame, key: str, declared: str, arrival: str) -> DataFrame:
    """Rows with a declared rank, each rank of a key once (the first to arrive), with rank counted anew from 1."""
    once = latest(df.where(F.col(declared).isNotNull()), [key, declared], F.asc(arrival))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(declared)))


def first_seen(df: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """Distinct values of each key in the order in which they first occur, at most `most` of them; a hot key is pre-aggregated."""
    once = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("__at"))
    w = Window.partitionBy(key).orderBy("__at", value)
    few = once.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__n", value))), lambda x: x[value])
    return few.groupBy(key).agg(listed.alias("values"))


def resolve(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Adds resolved: a row's own value, else the dominant one of its key."""
    common = dominant(df, key, value, share).select(F.col(key).alias("__key"), F.col(value).alias("__common"))
    return df.join(common, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("resolved", F.coalesce(value, "__common")).drop("__key", "__common")
