"""Structured Streaming over event logs: tail, daily windows, latest state of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.session import scratch
from folioflow.streaming.upserts import UpsertTable


def tail(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}"):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events a day and type; an event more than `late` older than the newest that an earlier batch saw is dropped, and closed days leave the state."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def latest_state(events: DataFrame) -> DataFrame:
    """The newest event of each user by (ts, event_id)."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy("user_id").agg(last.alias("e")).select("user_id", F.col("e.event_id").alias("event_id"), F.col("e.event_type").alias("event_type"))


def reserved(jobs: DataFrame, keys: Sequence[str], at: str, active: str) -> DataFrame:
    """The first request of each key; one that comes while an earlier one of its key is active reuses that one and is dropped.

    A key is active for `active` after its request, and its state leaves when the watermark has passed that, so the state holds
    the keys of that span only. Requests more than `active` late are dropped. A batch that runs again gives the same.
    """
    return jobs.withWatermark(at, active).dropDuplicatesWithinWatermark(list(keys))


def drained(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregated stream over what is there now and give its result, one row for each of keys.

    Batches hold only the rows that they changed and are merged into an UpsertTable, so its files don't grow with the
    number of batches, and one that runs again changes nothing. State and rows stand in the shared folder, never on
    the driver. A later call of the same name goes on where this one stopped.
    """
    spark = stream.sparkSession
    base = f"{scratch(spark)}/folioflow-{spark.sparkContext.applicationId}/stream-{name}"
    out = UpsertTable(spark, f"{base}/out", stream.schema, keys)
    query = stream.writeStream.foreachBatch(out.merge).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.table()


def logged(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream that only appends over what is there now and give all that it has written, each row once."""
    spark = stream.sparkSession
    base = f"{scratch(spark)}/folioflow-{spark.sparkContext.applicationId}/log-{name}"
    stream.writeStream.format("parquet").option("path", f"{base}/log").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/log")


def until_final(events: DataFrame, key: str, order: Sequence[str], final: Column) -> DataFrame:
    """The events of each key up to its first final one, that included; what a reader of the tail sees before it stops."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.coalesce(final, F.lit(False)).cast("int")).over(w), F.lit(0))
    return events.withColumn("__ended", ended).where("__ended = 0").drop("__ended")
