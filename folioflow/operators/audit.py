"""Audits of files that reuse what is known: results belong to a file's content and the engine's version, not to its name."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioflow.session import written
from folioflow.sources.units import opened

MANIFEST = "path string, length long, modified timestamp, sha256 string"
#: Folders that one task lists, files and bytes of files that one task opens, and bytes that it hands on at once.
FOLDERS, OPENS, PART_BYTES, BATCH_BYTES = 50, 2_000, 128 << 20, 4 << 20


def _below(folder: str, name: str) -> str:
    """Path or URI of what a folder holds under a name."""
    if "://" not in folder and not folder.startswith("file:"):
        return posixpath.join(folder, name)
    parts = urlsplit(folder)
    return parts._replace(path=posixpath.join(parts.path, quote(name))).geturl()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, length, modified, folder of what each given folder holds directly, without hidden names; a file stands for itself."""
    names, kinds = ["path", "length", "modified", "folder"], [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, own = opened(path)
            info = system.get_file_info(own)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            inner = [(path, info)] if info.type == fs.FileType.File else [(_below(path, x.base_name), x) for x in system.get_file_info(fs.FileSelector(own)) if x.base_name[:1] not in "._"]
            rows = [(p, x.size, (x.mtime_ns or 0) // 1000, x.type == fs.FileType.Directory) for p, x in inner]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified of the files below a path, names that begin with a dot or underscore left out; their content isn't read.

    Tasks list the folders, one level after the other, and the files come as a table, so the driver has none of their names.
    """
    folders, n, levels = spark.createDataFrame([(path,)], "path string"), 1, []
    while n:
        found = folders.repartition(-(-n // FOLDERS), "path").mapInArrow(_listed, "path string, length long, modified timestamp, folder boolean")
        levels.append(written(found, "audit-listing"))
        folders = levels[-1].where("folder").select("path")
        n = folders.count()
    return reduce(DataFrame.union, levels).where("not folder").select("path", "length", "modified")


def dealt(files: DataFrame) -> DataFrame:
    """files (path, length, ...) in parts of at most about OPENS files and PART_BYTES bytes, as tasks open them."""
    stored = written(files, "audit-paths")
    n, size = stored.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return stored.repartition(max(1, -(-n // OPENS), -(-size // PART_BYTES)), "path")


def contents(files: DataFrame) -> DataFrame:
    """files (path, ...) with the content of each, which the task that its row is in opens."""
    names = [*files.columns, "content"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, start, size = [], 0, 0
            for i, path in enumerate(batch.column("path").to_pylist(), 1):
                system, own = opened(path)
                with system.open_input_file(own) as f:
                    held.append(f.read())
                size += len(held[-1])
                if i == batch.num_rows or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, i - start).columns, pa.array(held, pa.binary())], names)
                    held, start, size = [], i, 0

    return files.mapInArrow(read, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in files.schema), "content binary"]))


def audited(files: DataFrame, manifest: DataFrame, results: DataFrame, version: str, engine: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, Observation]:
    """The new manifest (path, length, modified, sha256), the new results (sha256, version, and what the engine gives), and totals of this run.

    A file whose path, length and time stand in the manifest has the digest there and isn't opened. Others are read once for
    their digest; of these, contents that have no result of this version go through the engine, one file of each content.
    engine takes rows (sha256, content) and gives rows with sha256. The observation counts opened, and the bytes opened.
    """
    key = ["path", "length", "modified"]
    # Both sides grow with the number of files, and paths pack so well that a table's bytes on disk say little of its rows.
    known = files.join(manifest.select(*key, "sha256").hint("merge"), key)
    fresh = dealt(files.join(manifest.select(*key).hint("merge"), key, "left_anti"))
    seen = Observation()
    read = contents(fresh).observe(seen, F.count("*").alias("opened"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("bytes"))
    digests = written(read.select(*key, F.sha2("content", 256).alias("sha256")), "audit-digests")
    now = written(known.select(*key, "sha256").union(digests), "audit-manifest")
    # Files of one content are brought together before rows are dealt by content, so a frequent one is no larger than others.
    one = now.groupBy("sha256").agg(F.min(F.struct("path", "length")).alias("f")).select("f.path", "f.length", "sha256")
    missing = one.join(results.where(F.col("version") == version).select("sha256").distinct(), "sha256", "left_anti")
    ran = engine(contents(dealt(missing)).select("sha256", "content")).withColumn("version", F.lit(version))
    return now, results.unionByName(written(ran.select(*results.columns), "audit-results")), seen


def corpus(manifest: DataFrame, results: DataFrame, version: str) -> DataFrame:
    """manifest with the results of each file's content: every file of a corpus, whichever run judged its content."""
    return manifest.join(results.where(F.col("version") == version).drop("version"), "sha256", "left")
