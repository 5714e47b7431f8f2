"""Readers of files and archives, sinks and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.functions import layout as Y
from folioflow.functions import nested as N
from folioflow.functions import text as T
from folioflow.operators import ledgers as L
from folioflow.sources import catalogs, files
from folioflow.streaming import events as S


def archive(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def p(text):
    return f"<w:p><w:t>{text}</w:t></w:p>"


def w(inner, tag="document"):
    return f'<w:{tag} xmlns:w="w">{inner}</w:{tag}>'


WORD = archive(**{
    "word/document.xml": w(f"<w:body>{p('Hello')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('')}</w:body>"),
    "word/header1.xml": w(p("Top"), "hdr"), "word/footnotes.xml": w(f"<w:footnote>{p('Note')}</w:footnote>", "footnotes"), "word/comments.xml": w(f"<w:comment>{p('Why')}</w:comment>", "comments"),
})
SLIDES = archive(**{f"ppt/slides/slide{i}.xml": w(p(f"s{i}")) for i in (1, 2, 10)}, **{"ppt/notesSlides/notesSlide2.xml": w(p("say"))})
SHEETS = archive(**{
    "xl/workbook.xml": '<workbook><sheets><sheet name="Plan"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>one</t></si><si><t>two</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<ws><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="B1"><f>SUM(C1:C3)</f><v>6</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></ws>',
    "xl/comments1.xml": '<comments><comment ref="A1"><t>check</t></comment></comments>',
})
PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (20).to_bytes(2, "big") + (30).to_bytes(2, "big") + b"\0" * 12


def test_every_kind_of_file_becomes_units(spark):
    rows = [("a.docx", WORD), ("b.pptx", SLIDES), ("c.xlsx", SHEETS), ("d.png", PNG), ("e.jpg", JPEG), ("f.pdf", b"%PDF-1.7"), ("g.docx", b"PK\x03\x04broken"), ("h.txt", None), ("i.zip", archive(x="y"))]
    got = {}
    for r in files.file_units(spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "path string, content binary")).orderBy("path", "ordinal").collect():
        got.setdefault(r.path, []).append((r.unit_type, r.text, r.status))
    ok = "processed"
    assert got["a.docx"] == [("block", "Hello", ok), ("table_row", "a\tb", ok), ("block", "", "empty"), ("comment", "Why", ok), ("footnote", "Note", ok), ("header", "Top", ok)]
    assert got["b.pptx"] == [("slide", "s1", ok), ("slide", "s2", ok), ("notes", "say", ok), ("slide", "s10", ok)]
    assert got["c.xlsx"] == [("formula", "Plan!B1=SUM(C1:C3)", ok), ("row", "Plan\ttwo\t6", ok), ("merged", "Plan!A1:B2", ok), ("comment", "A1: check", ok)]
    assert got["d.png"] == [("image", "640x480", "ocr_required")] and got["e.jpg"] == [("image", "30x20", "ocr_required")]
    assert got["f.pdf"] == [("broken", "", "failed")] and got["g.docx"] == [("broken", "", "failed")] and got["h.txt"] == [("line", "", "empty")] and "i.zip" not in got


def test_sheets_become_tables_and_evidence(spark):
    rows = [("row", 0, "Plan\tGroup\tName\tNote"), ("row", 1, "Plan\tk1\tfirst\tsee https://a.example/x https://a.example/x"), ("row", 2, "Plan\tk2\t\tthe review was done"), ("formula", 3, "Plan!A1=1"), ("row", 4, "Other\tName"), ("row", 5, "Other\tz")]
    units = spark.createDataFrame([("c.xlsx", *r) for r in rows], "path string, unit_type string, ordinal int, text string")
    got = catalogs.sheet_table(units, {"GROUP": "kk", "name": "parameter"}).orderBy("ordinal").collect()
    assert [(r.sheet, r.ordinal, r.kk, r.parameter) for r in got] == [("Plan", 1, "k1", "first"), ("Plan", 2, "k2", None), ("Other", 5, None, "z")]
    seen = {r.ordinal: (r.text, r.links, r.stages) for r in catalogs.sheet_evidence(units, {"evaluation": ("review", "audit"), "policy": ("rule",)}).collect()}
    assert seen[1] == ("k1 | first | see https://a.example/x https://a.example/x", ["https://a.example/x"], [])
    assert seen[2] == ("k2 | the review was done", [], ["evaluation"])


def test_nested_catalogs(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"kk": "a",\n "parameters": [{"name": "p", "grades": ["A", "B"]}, {"name": "q"}]}, {"kk": "b", "parameters": []}]')
    got = catalogs.exploded(catalogs.read(spark, str(tmp_path / "c.json"))).collect()
    assert sorted(map(tuple, got)) == [("a", "p", "A"), ("a", "p", "B")]
    assert catalogs.parsed(spark.createDataFrame([("no json",), (None,)], "v string"), "v").count() == 0


def test_archive_members_are_inspected(spark):
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("ok.txt", "x"), ("../up", "x"), ("OK.TXT", "y"), ("bomb", "0" * 200_000), ("dir/", "")):
            z.writestr(name, text)
        z.writestr(link, "target")
    df = spark.createDataFrame([("a.zip", bytearray(buffer.getvalue())), ("b.zip", bytearray(b"PK no")), ("c.zip", None)], "path string, content binary")
    got = {(r.path, r.member): r.finding for r in files.members(df).collect()}
    assert got == {("a.zip", "ok.txt"): None, ("a.zip", "../up"): "traversal", ("a.zip", "OK.TXT"): "collision", ("a.zip", "bomb"): "ratio", ("a.zip", "link"): "symlink", ("b.zip", None): "broken", ("c.zip", None): "broken"}
    small = {r.finding for r in files.members(df.where("path = 'a.zip'"), most_entries=3, most_bytes=1_000).where("member is null").collect()}
    assert small == {"entries", "total"}


@pytest.mark.parametrize(("raw", "want"), [(b"\xef\xbb\xbfa", ("a", "utf-8-sig")), ("é".encode("utf-16"), ("é", "utf-16")), ("é".encode(), ("é", "utf-8")), (b"\xe9", ("é", "cp1252")), (b"\xe9\x81", ("é�", "cp1252")), (b"", ("", "utf-8"))])
def test_encodings(raw, want):
    assert files.with_encoding(raw) == want


def test_only_written_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    L.write_replacing(spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string"), path, ["k"])
    L.write_replacing(spark.createDataFrame([(3, "b")], "x int, k string"), path, ["k"])
    assert sorted((r.x, r.k) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_late_events_are_dropped_and_days_go_on(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    put = lambda rows: spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    drain = lambda: {(str(r.day), r.event_type): r.n for r in S.drained(S.daily(S.tail(spark, path, spark.read.parquet(path).schema)), f"t-{tmp_path.name}", ["day", "event_type"]).collect()}
    put([(1, "2024-01-05 10:00:00", "a"), (2, "2024-01-05 11:00:00", "a"), (3, "2024-01-01 10:00:00", "a")])
    assert drain() == {("2024-01-05", "a"): 2, ("2024-01-01", "a"): 1}
    put([(4, "2024-01-01 12:00:00", "a"), (5, "2024-01-05 12:00:00", "a"), (6, "2024-01-06 01:00:00", "b")])
    # the second event of 1 January comes over a day after the newest that was seen: it is dropped
    assert drain() == {("2024-01-05", "a"): 3, ("2024-01-01", "a"): 1, ("2024-01-06", "b"): 1}


def test_stream_reads_all_partition_folders(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    df = spark.range(20).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("a").alias("event_type"), (F.col("id") % 3).cast("int").alias("p"))
    df.write.partitionBy("p").parquet(path)
    found = S.drained(S.daily(S.tail(spark, path, spark.read.parquet(path).schema)), f"p-{tmp_path.name}", ["day", "event_type"]).collect()
    assert [r.n for r in found] == [20]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("ref", "want"), [("A1:B2", ["A1", "B1", "A2", "B2"]), ("B2:A1", ["A1", "B1", "A2", "B2"]), ("z1:AB1", ["Z1", "AA1", "AB1"]), ("ZZ9:AAA9", ["ZZ9", "AAA9"]), ("$C$3:$C$4", ["C3", "C4"]), ("A1", ["A1"]), ("A:B", ["A:B"]), ("A1:ZZ99", None)])
def test_cells(spark, ref, want):
    got = one(spark, Y.cells(F.lit(ref)))
    assert got == want if want else len(got) == Y.MOST_CELLS


def plain_pages(n, limit):
    if n <= limit:
        return list(range(max(n, 0)))
    chosen = {*range(3), *range(n - 3, n), *range(n // 2 - 2, n // 2 + 2)}
    room = max(0, limit - len(chosen))
    for i in range(n // (room + 1) or 1, n, n // (room + 1) or 1) if room else ():
        chosen.add(i)
        if len(chosen) >= limit:
            break
    return sorted(chosen)[:limit]


def test_sampled_pages(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 5, 11, 12, 13, 40, 41, 500)], "n int")
    for limit in (4, 10, 12, 20):
        assert {r.n: list(r.p) for r in df.select("n", Y.sampled_pages(F.col("n"), limit).alias("p")).collect()} == {r.n: plain_pages(r.n, limit) for r in df.collect()}


def test_tiles_hold_their_pixels(spark):
    for w_, h in ((1, 1), (5000, 3), (3000, 4000), (999, 1001)):
        g = one(spark, Y.tile_grid(F.lit(w_), F.lit(h), 1_000_000))
        assert -(-w_ // g.columns) * -(-h // g.rows) <= 1_000_000


def test_nested_values(spark):
    deep = '{"b": [{"p": "/old/x"}, "/old", 1, null], "a": "/old/"}'
    assert one(spark, N.rewritten(F.lit(deep), "/old/", "/n/")) == '{"a":"/n/","b":[{"p":"/n/x"},"/old",1,null]}'
    assert one(spark, N.canonical_hash(F.lit('{"b":1,"a":2}'))) == one(spark, N.canonical_hash(F.lit(' {"a": 2, "b": 1}')))
    assert one(spark, N.canonical_hash(F.lit("no"))) is None and one(spark, N.canonical_hash(F.lit(None).cast("string"))) is None
    assert one(spark, N.decoded(F.lit('{"k": "x"}'), "$.k", "int", 7)) == 7


def test_texts(spark):
    assert one(spark, T.http_date(F.lit("Tue, 15 Nov 1994 08:12:31 GMT"))) == "1994-11-15T08:12:31Z"
    assert one(spark, T.http_date(F.lit("Tue, 99 Nov 1994 08:12:31 GMT"))) is None
    assert one(spark, T.public_link("https://x/", F.lit("a b/ü&c"))) == "https://x/a%20b/%C3%BC%26c"
    assert one(spark, T.narrative(F.lit("# Top\n- **one** [two](http://x)\n```sql\ncode```"))) == "Top one two code"
    assert one(spark, T.whole_sentences(F.lit("One. Two three four."), 10)) == "One."
    assert one(spark, T.whole_sentences(F.lit("abcdef ghijkl"), 7)) == "abcdef"


def test_ledgers_of_empty_tables(spark):
    e = lambda kinds: spark.createDataFrame([], kinds)
    assert L.optimistic(e("k int, e int, f boolean"), spark.createDataFrame([(1, None), (2, 3)], "k int, expected int"), "k", "e", F.col("f")).orderBy("k").select("verdict").collect() == [("accepted",), ("conflict",)]
    assert L.replaced(e("k int"), e("k int"), ["k"]).count() == 0
    report = L.gold_report(e("n_expected int, n_shown int, n_relevant int, n_sources int, n_found_sources int, expected_grade int, predicted_grade int, expected_role string, predicted_role string, expected_template string, predicted_template string, latency double, cost double")).first()
    assert report.cases == 0 and report.recall_at_5 == 0 and report.overgrade_rate == 1.0
