"""A keyed table that batches are merged into: a base in buckets of keys and a few deltas, compacted bucket by bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from folioflow.operators.relational import latest

#: Buckets of a table and batches that stand as deltas before the base takes them in.
BUCKETS, MOST_DELTAS = 16, 8


class UpsertTable:
    """Below `path`: base/bucket=k/ with one row a key, and delta/batch=n/bucket=k/ with what later batches changed.

    A batch that runs again overwrites its own delta. Compaction merges base and deltas of the buckets that deltas touch,
    writes these aside, replaces exactly these partitions of the base, and then drops the deltas it took in. It may stop
    anywhere: the deltas stay until the base has them, and merging them again gives the same rows. The row of the highest
    batch counts for a key, so the files are at most one for each bucket and task of the base, and those of MOST_DELTAS batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.keys, self.buckets, self.most_deltas = spark, path, list(keys), buckets, most_deltas
        self.fields = schema.fieldNames()
        # All columns are nullable in files; bucket and batch are partitions.
        own = [StructField(f.name, f.dataType) for f in schema.fields]
        self._base = StructType([*own, StructField("__batch", LongType()), StructField("bucket", IntegerType())])
        self._delta = StructType([*own, StructField("__batch", LongType()), StructField("batch", LongType()), StructField("bucket", IntegerType())])

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        system, path = self._folder(name)
        return system.exists(path)

    def deltas(self) -> list[int]:
        """Numbers of the batches that stand as deltas; MOST_DELTAS and a few at most."""
        system, path = self._folder("delta")
        if not system.exists(path):
            return []
        names = [x.getPath().getName() for x in system.listStatus(path)]
        return sorted(int(x.removeprefix("batch=")) for x in names if x.startswith("batch="))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in a batch with at most one row a key."""
        rows = batch.select(*self.fields).withColumns({"__batch": F.lit(number).cast("long"), "bucket": self._bucket()})
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/batch={number}")
        if len(self.deltas()) > self.most_deltas:
            self.compact()

    def _read(self, name: str, schema: StructType) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _rows(self) -> DataFrame:
        """Base and deltas, the last row of each key."""
        both = self._read("base", self._base).unionByName(self._read("delta", self._delta).drop("batch"))
        return latest(both, [*self.keys, "bucket"], F.desc("__batch"))

    def table(self) -> DataFrame:
        return self._rows().select(*self.fields)

    def compact(self) -> None:
        taken = self.deltas()
        touched = [r.bucket for r in self._read("delta", self._delta).select("bucket").distinct().collect()]  # BUCKETS at most
        aside = f"{self.path}/aside"
        merged = self._rows().where(F.col("bucket").isin(touched))
        merged.repartition(len(touched) or 1, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(aside)
        done = self._read("aside", self._base)
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/base")
        for name in [*(f"delta/batch={n}" for n in taken), "aside"]:
            system, path = self._folder(name)
            system.delete(path, True)

    def files(self) -> int:
        """Data files of base and deltas."""
        return sum(1 for name in ("base", "delta") if self._exists(name) for f in self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}").inputFiles() if f)
