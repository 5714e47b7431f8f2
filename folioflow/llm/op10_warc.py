"""WARC: write pages as archives, read them back, and merge their index into ordered capture histories.

Archives are cut by bytes, so one is read as one row of bounded size. Each gives a run of captures
sorted by (URL key, time, page, place). The runs are cut at common boundaries, as many as the number of
captures asks for, and the pieces of a range, whose size doesn't grow with the table, are merged by a
k-way loser tree. The ranges in their order are one globally sorted index.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import blocks, partitions, scratch_root, smallest_hashes, stored, table

#: Fixed values of the WARC format.
_CRLF = "\r\n"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST = 100
#: Bounds of an archive; a record that is larger than FILE_BYTES stands alone in its archive.
RECORDS_A_FILE, FILE_BYTES = 1_000, 32 << 20
#: Captures that a merged range is meant to hold, and keys that are sampled for each range's boundary.
RANGE_ROWS, SAMPLED_A_RANGE = 100_000, 16


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then the path; lower case, without scheme, `www.` and fragment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\d*\.)?|#.*$", "")
    host = F.regexp_extract(bare, r"^([^/?]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?]*", ""))


def records(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """page_id and record string: one WARC record for each row of pages.

    A null html is an empty payload. Of equal payloads of SMALLEST bytes or more the row of smallest
    page_id is the response, the others are revisits of it without a body; rows that share that
    smallest page_id are all responses. A null page_id compares as the largest. A null url is empty.
    Record ids are UUIDs made of a random name of this call and the row's place, so repeated rows
    have ids of their own. captured is the time of capture, a timestamp over pages; without it the
    time is made from page_id, since the tables hold none: page n is n seconds after a fixed day.
    """
    html = F.coalesce("html", F.lit(""))
    made = F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce(F.col("page_id").cast("long"), F.lit(0)) % 100_000_000)
    df = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
        F.date_format(F.coalesce(captured, made) if captured is not None else made, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"),
    )
    # Ids, URLs and digests only are shuffled to find the first of each payload; the payloads stay where they are.
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date")))
    light = df.where(F.col("payload_bytes") >= SMALLEST).groupBy("payload_digest").agg(first.alias("first"), F.count("*").alias("n"))
    repeated = stored(light.where("n > 1").drop("n"), "warc-repeated")
    df = df.join(repeated, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    df = df.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    hex_ = F.md5(F.concat(F.lit(uuid.uuid4().hex), F.monotonically_increasing_id().cast("string")))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hex_, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-8$4-$5"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("X-URL-Key", url_key(F.col("url"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit(_PROFILE)),
                line("WARC-Refers-To-Target-URI", F.col("first.url")),
                line("WARC-Refers-To-Date", F.col("first.date")),
                line("X-Refers-To-Page-ID", F.col("first.page_id").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(_CRLF),
    )
    return df.select("page_id", F.concat(header, body).alias("record"))


def write_archives(pages: DataFrame, path: str, captured: Column | None = None) -> str:
    """WARC files below path of RECORDS_A_FILE records and FILE_BYTES bytes at most; the text writer ends a record by two line ends.

    Records that are too large for RECORDS_A_FILE of them to fit go by classes, each of twice the
    size of the one before: a folder takes so many consecutive rows that all of its class would fit.
    """
    small = FILE_BYTES // RECORDS_A_FILE
    class_ = F.greatest(F.lit(0), F.ceil(F.log2(F.octet_length("record") / small))).cast("int")
    fit = F.greatest(F.lit(1), F.floor(F.lit(RECORDS_A_FILE) / F.pow(F.lit(2), F.col("class"))))
    folder = F.when(F.col("class") == 0, "0").otherwise(F.concat_ws("-", "class", F.floor(F.monotonically_increasing_id() / fit)))
    rows = records(pages, captured).select("record", class_.alias("class")).select("record", folder.alias("folder"))
    rows.write.partitionBy("folder").option("lineSep", _END).option("maxRecordsPerFile", RECORDS_A_FILE).text(path)
    return path


def parse(raw: bytes) -> Iterator[dict]:
    """The captures of one archive: header fields, offset and body."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in raw[at:stop].decode("utf-8").split(_CRLF)[1:])
        size = int(fields["Content-Length"])
        yield {"fields": fields, "offset": at, "body": raw[stop + 4 : stop + 4 + size]}
        if raw[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at {at} doesn't end where its length says")
        at = stop + 8 + size


_CAPTURE = "key string, stamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
_FIELDS = [x.split()[0] for x in _CAPTURE.split(", ")]


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A sorted run of captures for each archive: run string, captures array<struct>. Bodies are checked against their digests."""
    import hashlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py()
                out = []
                for x in parse(batch.column(1)[i].as_py()):
                    h = x["fields"]
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and hashlib.sha256(x["body"]).hexdigest() != digest:
                        raise ValueError(f"{file} at {x['offset']}: the payload has another digest")
                    size = len(x["body"]) if h["WARC-Type"] == "response" else int(h["X-Payload-Length"])
                    out.append((h["X-URL-Key"], h["WARC-Date"], _number(h.get("X-Page-ID")), size, digest, h["WARC-Type"], _number(h.get("X-Refers-To-Page-ID")), file, x["offset"]))
                out.sort(key=_order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([[dict(zip(_FIELDS, x, strict=True)) for x in out]], pa.list_(_ARROW))], ["run", "captures"]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, f"run string, captures array<struct<{_CAPTURE.replace(' ', ':').replace(',:', ',')}>>")


_ARROW = pa.struct([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in _CAPTURE.split(", "))])


def _order(x: tuple) -> tuple:
    return (x[0], x[1], x[2] is None, x[2] or 0, x[7], x[8])


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner of all comes out."""

    def __init__(self, sorted_runs: list[list[tuple]]):
        self.runs, self.at = sorted_runs, [0] * len(sorted_runs)
        self.k = max(len(sorted_runs), 1)
        self.losers = [-1] * self.k
        for run in range(len(sorted_runs)):
            self._replay(run, True)

    def _head(self, run: int) -> tuple | None:
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def _replay(self, run: int, first: bool = False) -> None:
        node = (run + self.k) // 2
        while node:
            if self.losers[node] < 0 and first:
                self.losers[node] = run  # waits for its opponent
                return
            if not self._beats(run, self.losers[node]):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            run = self.losers[0]
            head = self._head(run)
            if head is None:
                return
            yield head
            self.at[run] += 1
            self._replay(run)


def _orders(captures: pa.StructArray) -> list[tuple]:
    """The global order of captures: URL key, time, page (null last), then file and offset, which no two share."""
    key, stamp, page, file, offset = (captures.field(_FIELDS.index(n)).to_pylist() for n in ("key", "stamp", "page_id", "file", "offset"))
    return [(k, t, p is None, p or 0, f, o) for k, t, p, f, o in zip(key, stamp, page, file, offset, strict=True)]


def merged(sorted_runs: DataFrame, least_ranges: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs with range and place: (range, place) is their global order.

    There are as many ranges as hold range_rows captures each, `least_ranges` at least. Boundaries come
    from SAMPLED_A_RANGE keys a range and compare captures to the last field, so repeated rows of one
    page are cut as well.
    """
    every = sorted_runs.select(F.explode("captures").alias("c")).select("c.key", "c.stamp", "c.page_id", "c.file", "c.offset")
    count = every.count()
    ranges = max(least_ranges, blocks(count, range_rows))
    got = smallest_hashes(every, count, SAMPLED_A_RANGE * ranges, *every.columns).collect()
    sample = sorted((r.key, r.stamp, r.page_id is None, r.page_id or 0, r.file, r.offset) for r in got)
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                captures = batch.column(1).slice(i, 1).flatten()
                at = _orders(captures)
                # Only the boundaries between the run's ends are looked at.
                low = bisect_left(bounds, at[0]) if at else 0
                start = 0
                while start < len(at):
                    while low < len(bounds) and bounds[low] <= at[start]:
                        low += 1
                    stop = bisect_left(at, bounds[low], start) if low < len(bounds) else len(at)
                    piece = pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), captures.slice(start, stop - start))
                    yield pa.RecordBatch.from_arrays([pa.array([low]), batch.column(0).slice(i, 1), piece], ["range", "run", "captures"])
                    start = stop

    def merge(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("run").combine_chunks()
        lists = pieces.column("captures").combine_chunks()
        captures = lists.flatten()
        orders = _orders(captures)
        ends = [0]
        for n in lists.value_lengths().to_pylist():
            ends.append(ends[-1] + n)
        heads = [list(zip(orders[a:b], range(a, b), strict=True)) for a, b in zip(ends, ends[1:], strict=False)]
        captures = captures.take(pa.array([i for _, i in LoserTree(heads)], pa.int64()))
        n = len(captures)
        return pa.table([pa.array([pieces.column("range")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), *captures.flatten()], names=["range", "place", *_FIELDS])

    captures = sorted_runs.schema["captures"].dataType.simpleString()
    pieces = sorted_runs.mapInArrow(cut, f"range long, run string, captures {captures}")
    return pieces.groupBy("range").applyInArrow(merge, f"range long, place long, {_CAPTURE}")


def capture_index(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """Write pages as archives in the shared folder, read these back and give their merged index."""
    spark = pages.sparkSession
    path = write_archives(pages, f"{scratch_root(spark)}/folioflow-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}", captured)
    return merged(stored(runs(spark, path), "warc-runs"), 2 * partitions(spark))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return capture_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as n, sha256(html) as digest from p),
f as (select digest, min(page_id) as first_id from d where n >= 100 group by digest)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.digest as payload_digest,
  case when f.first_id is not null and d.page_id is distinct from f.first_id then 'revisit' else 'response' end as record_type,
  case when f.first_id is not null and d.page_id is distinct from f.first_id then f.first_id end as refers_to
from d left join f on d.digest = f.digest
"""
