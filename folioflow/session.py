"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH = "1000"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, wherever the driver imported it from. Idempotent.

    Where the session has Spark's default of 10,000 rows an Arrow batch it gets BATCH, since a row
    may hold a whole text and a batch stands in a worker's memory.
    """
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, BATCH)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="folioflow-"), "folioflow.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(here.rglob("*.py")):
                archive.write(path, str(Path(here.name) / path.relative_to(here)))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, `spark.checkpoint.dir`. A local session without it uses one of its own; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/folioflow-checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table below the shared folder, read again: what several parts of a plan use is made once, and its size is known."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/folioflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
