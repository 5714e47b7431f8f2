"""Units of files as a Spark source, and files as a sink.

    spark.read.format("folioflow_units").load(folder)       # rows of files.UNITS
    df.write.format("folioflow_files").save(folder)         # one file a row of (name, content)
    saved(df, folder)                                       # the same for any number of files

`register(spark)` makes source and sink known. Folders may be plain paths or URIs of any store that pyarrow.fs opens.
Partitions are planned by file size: small files share one, and a large PDF is read in shares of its pages
by several. Filters on kind and path are pushed down; a file of another kind is known by its first bytes, and not read on.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.session import written
from folioflow.sources import files

#: Bytes of files in a partition, by default, and bytes of a PDF from which its pages are shared out.
PARTITION_BYTES = 64 << 20
#: Files that one task moves.
MOVES = 2_000
#: First bytes of a file that tell its kind.
HEAD = 64 << 10


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), folder


@dataclass
class Files(InputPartition):
    """Files of one partition: path, share of its pages, and number of shares."""

    files: list[tuple[str, int, int]]

    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(None)
        self.files = files


def planned(sizes: Sequence[tuple[str, int]], most: int) -> list[list[tuple[str, int, int]]]:
    """Files packed in the order of their paths into partitions of about `most` bytes; larger PDFs split, other larger files alone."""
    out, held, total = [], [], 0
    for path, size in sorted(sizes):
        if size > most and path.lower().endswith(".pdf"):
            shares = -(-size // most)
            out += [[(path, k, shares)] for k in range(shares)]
            continue
        if held and total + size > most:
            out, held, total = [*out, held], [], 0
        held.append((path, 0, 1))
        total += size
    return [*out, held] if held else out


class UnitsReader(DataSourceReader):
    def __init__(self, schema, options):
        self._schema, self._folder = schema, options["path"]
        self._most = int(options.get("partitionbytes", PARTITION_BYTES))
        self._kinds: set[str] | None = None
        self._paths: set[str] | None = None
        self._prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of kind and path, and prefixes of path; the rest stay with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "kind" and values is not None:
                self._kinds = values if self._kinds is None else self._kinds & values
            elif column == "path" and values is not None:
                self._paths = values if self._paths is None else self._paths & values
            elif column == "path" and isinstance(f, StringStartsWith) and f.value.startswith(self._prefix):
                self._prefix = f.value
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, base = opened(self._folder)
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self._folder)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = lambda x: any(p[:1] in "._" for p in x.path.removeprefix(base).split("/") if p)
        own = [(x.path, x.size or 0) for x in found if x.type == fs.FileType.File and (x is info or not hidden(x))]
        own = [x for x in own if (self._paths is None or x[0] in self._paths) and x[0].startswith(self._prefix)]
        return [Files(x) for x in planned(own, self._most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self._folder)
        schema = to_arrow_schema(self._schema)
        for path, part, parts in partition.files:
            with system.open_input_file(path) as f:
                if self._kinds is not None and files.kind_of(f.read(HEAD)) not in self._kinds:
                    continue
                f.seek(0)
                raw = f.read()
            yield from files.batched(files.units_of(path, raw, part, parts), schema)


class UnitsSource(DataSource):
    """Rows of files.UNITS of all files below a folder; names that begin with a dot or underscore are left out."""

    @classmethod
    def name(cls) -> str:
        return "folioflow_units"

    def schema(self) -> str:
        return files.UNITS

    def reader(self, schema) -> UnitsReader:
        return UnitsReader(schema, self.options)


def staged(batches: Iterator[pa.RecordBatch], folder: str, staging: str) -> Iterator[tuple[str, str]]:
    """Write rows (name, content) below a folder of this attempt in `staging`; where each file is held, and its name."""
    system, base = opened(folder)
    attempt, n = posixpath.join(base, staging, uuid.uuid4().hex), 0
    for batch in batches:
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
            steps = (name or "").split("/")
            if not name or name.startswith("/") or any(s in ("", ".", "..") for s in steps):
                raise ValueError(f"{name!r} is no name of a file below a folder")
            if not n:
                system.create_dir(attempt, recursive=True)
            held = posixpath.join(attempt, str(n))
            with system.open_output_stream(held) as f:
                f.write(content or b"")
            yield held, name
            n += 1


def moved(system: fs.FileSystem, base: str, held: str, name: str, made: set[str]) -> None:
    """Move a staged file to its name; `made` has the folders that are there. A file that an earlier attempt has moved stays."""
    target = posixpath.join(base, name)
    if (above := posixpath.dirname(target)) not in made:
        system.create_dir(above, recursive=True)
        made.add(above)
    try:
        system.move(held, target)
    except OSError:
        there = [x.type == fs.FileType.File for x in system.get_file_info([held, target])]
        if there != [False, True]:
            raise


def saved(df: DataFrame, folder: str) -> int:
    """Write one file a row of (name, content) below a folder, as the sink does in mode append; the number of files.

    The sink's names all pass the driver, which moves the files. Here tasks stage them and hand their names to a table,
    which is searched for names that several rows have, and then tasks move the files, MOVES each.
    """
    staging, spark = f"_temporary-{uuid.uuid4().hex}", df.sparkSession

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("held", pa.string()), ("name", pa.string())])
        yield from files.batched(staged(batches, folder, staging), schema)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, base), made, n = opened(folder), set(), 0
        for batch in batches:
            for held, name in zip(batch.column("held").to_pylist(), batch.column("name").to_pylist(), strict=True):
                moved(system, base, held, name, made)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    try:
        names = written(df.select("name", "content").mapInArrow(stage, "held string, name string"), "staged-files")
        if names.groupBy("name").count().where("count > 1").limit(1).count():
            raise ValueError("several rows have one name")
        parts = max(1, -(-names.count() // MOVES))
        return names.repartition(parts, "name").mapInArrow(move, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        if system.get_file_info(posixpath.join(base, staging)).type == fs.FileType.Directory:
            system.delete_dir(posixpath.join(base, staging))


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    """Each task writes below a folder of its attempt; the files move to their names when all tasks are done. The driver has all their names, `saved` does without."""

    def __init__(self, options, overwrite: bool):
        self._folder, self._overwrite, self._job = options["path"], overwrite, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return posixpath.join(base, f"_temporary-{self._job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(list(staged(iterator, self._folder, f"_temporary-{self._job}")))

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self._folder)
        system.create_dir(base, recursive=True)
        listed = [x for m in messages if m is not None for x in m.names]
        targets = [name for _, name in listed]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("several rows have one name")
        if self._overwrite:
            staged = posixpath.basename(self._staging(base))
            for x in system.get_file_info(fs.FileSelector(base)):
                if x.base_name != staged:
                    (system.delete_dir if x.type == fs.FileType.Directory else system.delete_file)(x.path)
        made: set[str] = set()
        for held, name in listed:
            moved(system, base, held, name, made)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = opened(self._folder)
        if system.get_file_info(self._staging(base)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(base))


class FilesSink(DataSource):
    """Writes one file a row of (name, content); mode overwrite replaces the folder's files."""

    @classmethod
    def name(cls) -> str:
        return "folioflow_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows of files have the columns name and content")
        return FilesWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make source and sink known to a session and let it push filters down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (UnitsSource, FilesSink):
        spark.dataSource.register(source)
    return spark
