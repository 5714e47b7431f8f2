"""Readers of files: text and office archives as units, archive members with safety checks."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from folioflow.sources import ooxml, pdf
from folioflow.sources.ooxml import MOST_BYTES, MOST_ENTRIES, MOST_RATIO


def binaries(spark: SparkSession, path: str, depth: bool = True) -> DataFrame:
    """path, length, content, sha256 of the files below a path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(depth).lower()).load(path)
    return df.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def with_encoding(raw: bytes) -> tuple[str, str]:
    """Text and encoding: what a byte-order mark says, else UTF-8 if it is that, else cp1252 with U+FFFD for what it lacks."""
    marks = {b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16", b"\xef\xbb": "utf-8-sig"}
    kind = marks.get(raw[:2], "utf-8")
    if kind == "utf-8":
        try:
            return raw.decode(kind), kind
        except UnicodeDecodeError:
            kind = "cp1252"
    return raw.decode(kind, "replace"), kind


def decoded(raw: bytes) -> str:
    return with_encoding(raw)[0]


def decoded_texts(files: DataFrame, id_: str) -> DataFrame:
    """id, text, encoding, n_replaced (characters U+FFFD) of files (id, content); a null content is empty."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [with_encoding(bytes(c) if c is not None else b"") for c in batch["content"]]
            yield pd.DataFrame({id_: batch[id_], "text": [x for x, _ in rows], "encoding": [k for _, k in rows], "n_replaced": [x.count("\ufffd") for x, _ in rows]})

    kind = files.schema[id_].dataType.simpleString()
    return files.select(id_, "content").mapInPandas(read, f"{id_} {kind}, text string, encoding string, n_replaced int")


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height that the header of a PNG, GIF, BMP or JPEG picture tells; null for anything else."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big")
    if raw[:4] == b"GIF8" and len(raw) >= 10:
        return int.from_bytes(raw[6:8], "little"), int.from_bytes(raw[8:10], "little")
    if raw[:2] == b"BM" and len(raw) >= 26:
        return int.from_bytes(raw[18:22], "little"), abs(int.from_bytes(raw[22:26], "little", signed=True))
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 <= len(raw):
        if raw[at] != 0xFF:
            break
        # a start of frame holds the size; other segments are skipped by their length
        if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


#: Characters that a unit's text has at most, and below how many a page with pictures waits for OCR.
MOST_TEXT, SPARSE_TEXT = 2_000_000, 200
#: Rows of units of files; heading is the path of headings above a unit, location and metadata are as each kind has them.
UNITS = "path string, kind string, unit_type string, ordinal int, text string, status string, heading array<string>, location map<string,string>, metadata map<string,string>, warning string"


def kind_of(head: bytes) -> str:
    """What a file is by its first bytes: zip, pdf, image or text."""
    if head[:4] == b"PK\x03\x04":
        return "zip"
    if b"%PDF-" in head[:1024]:
        return "pdf"
    return "image" if image_size(head) else "text"


def _pages(raw: bytes, part: int, parts: int) -> Iterator[ooxml.Unit]:
    """Pages of a PDF, or a share of them; without text, or with little beside pictures, a page waits for OCR."""
    for number, total, text, pictures, reason in pdf.pages(raw, part, parts):
        text = None if text is None else "\n".join(" ".join(line.split()) for line in text.split("\n")).strip()
        sparse = bool(text) and len(text) < SPARSE_TEXT and pictures > 0
        status = "failed" if text is None else "ocr_required" if not text or sparse else "processed"
        more = {"pages": str(total), "characters": str(len(text or "")), "pictures": str(pictures)}
        first = next((line for line in (text or "").split("\n") if line), "")
        heading = (first[:HEADING],) if first else ()
        yield ooxml.Unit("page", text, status, heading, {"page": str(number)}, more, reason or ("little text beside pictures" if sparse else None if text else "no text"))


#: Fixed value: characters of a heading that is guessed from a page's first line.
HEADING = 180


def units_of(path: str, raw: bytes, part: int = 0, parts: int = 1) -> Iterator[tuple]:
    """Rows of UNITS of one file; parts split the pages of a PDF, other files are wholly in part 0."""
    kind = kind_of(raw)
    if part and kind != "pdf":
        return
    if kind == "zip":
        found = ooxml.units(path, raw)
    elif kind == "pdf":
        found = _pages(raw, part, parts)
    elif kind == "image":
        width, height = image_size(raw)
        found = iter([ooxml.Unit("image", f"{width}x{height}", "ocr_required")])
    else:
        found = (ooxml.Unit("line", x) for x in decoded(raw).split("\n"))
    ordinal = -1
    while True:
        try:
            u = next(found, None)
        except pdf.Damaged as e:
            u, found = ooxml.Unit("broken", "", "failed", warning=str(e)), iter(())
            if part:  # the first part tells it
                return
        if u is None:
            return
        ordinal = ordinal + 1 if kind != "pdf" or u.kind == "broken" else int(u.place["page"]) - 1
        text, status, warning = u.text, u.status or ("processed" if (u.text or "").strip() else "empty"), u.warning
        if text is not None and len(text) > MOST_TEXT:
            text, status, warning = text[:MOST_TEXT], "partial", f"{len(text)} characters"
        yield path, kind, u.kind, ordinal, text, status, list(u.heading), u.place, u.more, warning


def file_units(files: DataFrame) -> DataFrame:
    """Rows of UNITS of files (path, content), by their bytes: units of an office archive, pages of a PDF, a picture's size
    (`ocr_required`), else lines of text. A null content is an empty text; a file or part that can't be read gives a `failed` unit with the reason."""
    schema = to_arrow_schema(_parse_datatype_string(UNITS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from batched(units_of(path, content.as_py() or b""), schema)

    return files.select("path", "content").mapInArrow(read, UNITS)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size; maps are given as dictionaries."""
    while held := list(itertools.islice(rows, size)):
        columns = [list(c.items()) if isinstance(c, dict) else c for r in held for c in r]
        n = len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(columns[i::n], f.type) for i, f in enumerate(schema)], schema=schema)


def members(files: DataFrame, most_ratio: float = MOST_RATIO, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, member, size, compressed, finding of each entry of zip files (path, content), and one row without a member for the archive if it is broken or too large.

    Findings: traversal, symlink, encrypted, ratio, collision (its name equals an earlier entry's but for case), broken,
    entries and total (the archive's bounds); null for a sound entry. Folders are left out.
    """

    def one(raw: bytes) -> Iterator[tuple]:
        try:
            entries = zipfile.ZipFile(io.BytesIO(raw)).infolist()
        except zipfile.BadZipFile:
            yield None, 0, 0, "broken"
            return
        total = sum(e.file_size for e in entries)
        if len(entries) > most_entries:
            yield None, total, len(raw), "entries"
        if total > most_bytes:
            yield None, total, len(raw), "total"
        seen: set[str] = set()
        for e in entries:
            name = e.filename.replace("\\", "/")
            if name.endswith("/"):
                continue
            found = {
                "traversal": name.startswith("/") or ".." in name.split("/") or name[1:2] == ":",
                "symlink": e.external_attr >> 16 & 0o170000 == 0o120000,
                "encrypted": bool(e.flag_bits & 1),
                "ratio": e.file_size > most_ratio * max(e.compress_size, 1),
                "collision": name.casefold() in seen,
            }
            seen.add(name.casefold())
            yield e.filename, e.file_size, e.compress_size, next((k for k, bad in found.items() if bad), None)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *x) for path, content in zip(batch["path"], batch["content"], strict=True) for x in one(bytes(content) if content is not None else b"")]
            yield pd.DataFrame(rows, columns=["path", "member", "size", "compressed", "finding"])

    return files.select("path", "content").mapInPandas(read, "path string, member string, size long, compressed long, finding string")
