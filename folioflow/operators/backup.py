"""Backups that are verified by a tree of digests and restored leaf by leaf.

A table's rows fall into leaves by the hash of their key. A leaf's digest doesn't depend on the order of its rows, a
node's is that of its children's. Two copies are compared from the root down, below differing nodes only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Children of a node, rows that a leaf is meant to hold, and most levels below the root.
FAN, LEAF_ROWS, MOST_LEVELS = 8, 50_000, 5
LEAF = "__leaf"


def levels_for(rows: int) -> int:
    """Levels below the root for a table of so many rows; copies that are compared have the same."""
    return min(MOST_LEVELS, max(1, math.ceil(math.log(max(1, rows / LEAF_ROWS), FAN))))


def with_leaf(df: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    return df.withColumn(LEAF, F.pmod(F.xxhash64(*keys), F.lit(FAN**levels)).cast("int"))


def _row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values by column name, so neither order nor nulls can be mistaken."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def tree(leaved: DataFrame, levels: int) -> DataFrame:
    """level, node, digest, n of every node above rows with a leaf; level 0 is the root, empty leaves have no node.

    Rows add up as the sums of four quarters of their digests, which partial aggregation does before the shuffle;
    rows that repeat count as often as they occur.
    """
    columns = [c for c in leaved.columns if c != LEAF]
    row = leaved.select(LEAF, _row_digest(columns).alias("d"))
    quarter = lambda k: F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    leaves = row.groupBy(LEAF).agg(F.count("*").alias("n"), *[quarter(k).alias(f"q{k}") for k in range(4)])
    level = leaves.select(F.lit(levels).alias("level"), F.col(LEAF).alias("node"), F.sha2(F.concat_ws(":", "n", *[F.col(f"q{k}") for k in range(4)]), 256).alias("digest"), "n")
    made = [level]
    for k in range(levels - 1, -1, -1):
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        up = made[-1].groupBy(F.floor(F.col("node") / FAN).cast("int").alias("parent")).agg(F.sum("n").alias("n"), F.sha2(F.to_json(children), 256).alias("digest"))
        made.append(up.select(F.lit(k).alias("level"), F.col("parent").alias("node"), "digest", "n"))
    return reduce(DataFrame.union, reversed(made))


def damaged(live: DataFrame, backup: DataFrame, levels: int) -> DataFrame:
    """Leaves (node, n_live, n_backup) in which two trees differ; a node's children are compared only if it differs itself."""
    found = None
    for k in range(levels + 1):
        side = lambda t, c: t.where(F.col("level") == k).select("node", F.col("digest").alias(f"d_{c}"), F.col("n").alias(f"n_{c}"))  # noqa: B023, E731
        both = side(live, "live").join(side(backup, "backup"), "node", "full")
        if found is not None:
            both = both.join(found.select(F.col("node").alias("above")), F.floor(F.col("node") / FAN) == F.col("above"), "left_semi")
        found = both.where(~F.col("d_live").eqNullSafe(F.col("d_backup"))).select("node", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_backup", F.lit(0)).alias("n_backup"))
    return found


def write(df: DataFrame, path: str, keys: Sequence[str], levels: int) -> None:
    """A copy in folders by leaf, and its tree beside it; a copy that was there is replaced."""
    leaved = with_leaf(df, keys, levels)
    leaved.repartition(LEAF).write.mode("overwrite").partitionBy(LEAF).parquet(f"{path}/rows")
    stored = leaved.sparkSession.read.schema(leaved.schema).parquet(f"{path}/rows")
    tree(stored, levels).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A copy's rows with their leaves."""
    return spark.read.parquet(f"{path}/rows")


def verify(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """Leaves in which a copy's rows differ from the tree that was written with it."""
    return damaged(tree(read(spark, path), levels), spark.read.parquet(f"{path}/tree"), levels)


def differences(live: DataFrame, backup: DataFrame, leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, state of the rows of damaged leaves that aren't the same in both copies: missing, extra or changed in the live one. Keys are unique in each."""
    own = [c for c in live.columns if c not in (*keys, LEAF)]
    some = lambda df, c: df.join(leaves.select(F.col("node").alias(LEAF)), LEAF, "left_semi").select(*keys, _row_digest([*keys, *own]).alias(c))
    both = some(live, "l").join(some(backup, "b"), list(keys), "full")
    state = F.when(F.col("l").isNull(), "missing").when(F.col("b").isNull(), "extra").otherwise("changed")
    return both.where(~F.col("l").eqNullSafe(F.col("b"))).select(*keys, state.alias("state"))


def restore(spark: SparkSession, live: str, backup: str, leaves: Sequence[int]) -> None:
    """Replace the given leaves of the live copy by the backup's; other leaves are neither read nor written.

    leaves are FAN ** MOST_LEVELS at most. A leaf that the backup lacks becomes empty.
    """
    if not leaves:
        return
    rows = read(spark, backup).where(F.col(LEAF).isin(list(leaves)))
    held = {r[LEAF] for r in rows.select(LEAF).distinct().collect()}
    rows.repartition(LEAF).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(LEAF).parquet(f"{live}/rows")
    for leaf in set(leaves) - held:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{live}/rows/{LEAF}={leaf}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
