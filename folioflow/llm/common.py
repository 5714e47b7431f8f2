"""Shared helpers of the corpus operators: scratch tables, empty frames and word rules."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import scratch

#: Fixed value of the word contract: a word is a run of characters outside this class.
GAP = r"[ \t-\r]+"

scratch_root = scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again.

    Cuts the lineage with files that survive a lost executor, and gives the planner a true size
    for its choice between a broadcast and a shuffled join. `purge` removes the files.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/folioflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """df, a small aggregate, in a sixteenth as many files: footers of many tiny ones would make the planner
    take it for too large to broadcast, and join rows by its keys, all of a hot one in one task."""
    return df.coalesce(max(1, partitions(df.sparkSession) // 16))


def purge(spark: SparkSession) -> None:
    """Remove every scratch table of this application; results that were not consumed yet are lost."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/folioflow-{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """text with only A-Z in lower case; the faster function serves texts that hold nothing else to change."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest_hashes(df: DataFrame, rows: int, most: int, *keys: str) -> DataFrame:
    """The `most` of df's `rows` rows that have the smallest hash of `keys`, ties by the keys.

    Each task of a sorted limit hands over up to `most` rows, which adds up over many tasks. So rows
    whose hash lies clearly above the sample's are dropped before: the tasks hand over about `most`
    rows in all. The margin is ten standard deviations; a few rows less come where it doesn't do.
    """
    hash_ = F.xxhash64(*keys)
    reach = most + 10 * math.sqrt(most) + 100
    if rows > reach:
        df = df.where(hash_ < F.lit(int(reach / rows * 2.0**64) - 2**63))
    return df.orderBy(hash_, *keys).limit(most)


def blocks(total: int, size: int, least: int = 1) -> int:
    return max(least, math.ceil(total / size))
