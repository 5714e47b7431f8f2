"""PDF pages, office archives with gaps, reordered parts and damage, the source of units and the sink of files."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.sources import archives, files, ooxml, pdf, units

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def built(objects, trailer="/Root 1 0 R", table=True):
    """A PDF of numbered objects with a classic table, or with none."""
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\n"), {}
    for n, x in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    at, size = len(out), max(objects) + 1
    if table:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 %s \n" % (places.get(n, 0), b"n" if n in places else b"f") for n in range(1, size))
        out += b"trailer\n<</Size %d %s>>\nstartxref\n%d\n%%%%EOF" % (size, trailer.encode(), at)
    return bytes(out)


def stream(data, more=b""):
    return b"<<%s/Length %d>>\nstream\n%s\nendstream" % (more, len(data), data)


def flat(data, more=b""):
    return stream(zlib.compress(data), b"/Filter/FlateDecode" + more)


HELVETICA = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"


def one_page(content, fonts=b"/F1 3 0 R", more=b"", extra=None):
    return {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[4 0 R]/Resources<</Font<<%s>>%s>>>>" % (fonts, more), 3: HELVETICA, 4: b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>", 5: content, **(extra or {})}


def texts(raw):
    return [t for _, _, t, _, _ in pdf.pages(raw)]


def test_text_operators_place_words_and_lines():
    content = rb"BT /F1 10 Tf 12 TL 50 700 Td (Hello) Tj 60 0 Td (far) Tj (near) Tj T* (next \(line\) \101\
joined) Tj (quoted) ' 1 0 0 1 50 600 Tm [(T) 80 (o) -400 (gap)] TJ ET q 2 0 0 2 0 0 cm BT /F1 5 Tf 1 0 0 1 25 200 Tm <4865> Tj ET Q"
    assert texts(built(one_page(stream(content)))) == ["Hello farnear\nnext (line) Ajoined\nquoted\nTo gap\nHe"]


def test_inline_pictures_and_unknown_operators_are_stepped_over():
    content = b"BI /W 1 /H 1 ID \x00(Tj\xff EI BT /F1 9 Tf 5 5 Td (a) Tj ET (x) foo BT /F1 9 Tf 5 50 Td (b) Tj ET"
    assert texts(built(one_page(stream(content)))) == ["a\nb"]


def test_to_unicode_maps_and_wide_fonts():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0003> <00480065> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<D83DDE00> <00df>] endbfrange"
    extra = {6: b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 7 0 R/DescendantFonts[8 0 R]>>", 7: flat(cmap), 8: b"<</DW 500/W[3[900] 16 18 400]>>"}
    raw = built(one_page(stream(b"BT /F2 10 Tf 5 5 Td <0003001000110012> Tj <00200021> Tj ET"), b"/F2 6 0 R", extra=extra))
    assert texts(raw) == ["Heabc\U0001f600ß"]


def test_differences_and_glyph_names():
    extra = {6: b"<</Type/Font/Subtype/Type1/Encoding<</Differences[65/eacute/fi/uni20AC 97/nosuch]>>>>"}
    assert texts(built(one_page(stream(b"BT /F2 10 Tf (ABC'a) Tj ET"), b"/F2 6 0 R", extra=extra))) == ["éfi€’�"]


def test_filters_and_predictors():
    hello = b"BT /F1 9 Tf (Hi) Tj ET"
    for content in (flat(hello), stream(hello.hex().encode() + b">", b"/Filter/ASCIIHexDecode"), stream(bytes([len(hello) - 1]) + hello + b"\x80", b"/Filter[/RunLengthDecode]")):
        assert texts(built(one_page(content))) == ["Hi"]
    rows = [b"abcd", b"abce", b"zzzz"]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above, strict=True)) for r, above in zip(rows, [b"\0" * 4, *rows], strict=False))
    assert pdf._unpredicted(up, {"Predictor": 12, "Columns": 4}) == b"".join(rows)
    for method in range(5):
        out, above = bytearray(), b"\0" * 4
        for r in rows:
            guess = lambda i, r=r, above=above, m=method: [0, r[i - 1] if i else 0, above[i], ((r[i - 1] if i else 0) + above[i]) // 2, paeth(r[i - 1] if i else 0, above[i], above[i - 1] if i else 0)][m]
            out += bytes([method]) + bytes((r[i] - guess(i)) & 255 for i in range(4))
            above = r
        assert pdf._unpredicted(bytes(out), {"Predictor": 15, "Columns": 4}) == b"".join(rows)
    assert pdf._unlzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def test_cross_reference_and_object_streams():
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[4 0 R]>>", 4: b"<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<</Font<</F1 3 0 R>>>>>>", 3: HELVETICA}
    heads, body = b"", b""
    for n, x in inner.items():
        heads, body = heads + b"%d %d " % (n, len(body)), body + x + b" "
    out = bytearray(b"%PDF-1.5\n")
    places = {}
    for n, x in {5: flat(b"BT /F1 9 Tf (In streams) Tj ET"), 6: flat(heads + body, b"/Type/ObjStm/N 4/First %d" % len(heads))}.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    at = len(out)
    entries = [(0, 0, 255), *[(2, 6, list(inner).index(n)) for n in (1, 2, 3, 4)], (1, places[5], 0), (1, places[6], 0), (1, at, 0)]
    raw = b"".join(struct.pack(">BHB", *e) for e in entries)
    packed = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(raw[i : i + 4], raw[i - 4 : i] if i else b"\0" * 4, strict=True)) for i in range(0, len(raw), 4))
    out += b"7 0 obj\n%s\nendobj\n" % flat(packed, b"/Type/XRef/Size 8/W[1 2 1]/Root 1 0 R/DecodeParms<</Predictor 12/Columns 4>>")
    whole = bytes(out) + b"startxref\n%d\n%%%%EOF" % at
    assert texts(whole) == ["In streams"]
    assert texts(whole.replace(b"startxref\n%d" % at, b"startxref\n7")) == ["In streams"]  # found by search


def test_a_file_without_a_table_is_searched_and_updates_win():
    objects = one_page(stream(b"BT /F1 9 Tf (old) Tj ET"))
    raw = built(objects, table=False) + b"5 0 obj\n" + stream(b"BT /F1 9 Tf (new) Tj ET") + b"\nendobj\n"
    assert texts(raw) == ["new"]
    first = built(objects)
    second = first + b"\n5 0 obj\n" + stream(b"BT /F1 9 Tf (second) Tj ET") + b"\nendobj\n"
    at = len(second)
    place = second.rindex(b"5 0 obj")
    second += b"xref\n5 1\n%010d 00000 n \ntrailer\n<</Size 6/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (place, first.rindex(b"xref\n0 "), at)
    assert texts(second) == ["second"]


def test_forms_are_entered_and_pictures_counted():
    more = b"/XObject<</P 6 0 R/G 7 0 R>>"
    extra = {6: stream(b"x", b"/Type/XObject/Subtype/Image/Width 1/Height 1"), 7: stream(b"BT /F1 9 Tf 1 1 Td (in a form) Tj ET /G Do", b"/Type/XObject/Subtype/Form/Resources<</Font<</F1 3 0 R>>/XObject<</Q 8 0 R/G 7 0 R>>>>"), 8: stream(b"y", b"/Subtype/Image")}
    (number, total, text, pictures, reason), = pdf.pages(built(one_page(stream(b"BT /F1 9 Tf 1 50 Td (page) Tj ET /G Do /P Do"), more=more, extra=extra)))
    assert (number, total, pictures, reason) == (1, 1, 2, None) and text.startswith("page\nin a form")


def rows(spark, *named):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in named], "path string, content binary")


def test_pages_become_units(spark):
    long = b"BT /F1 9 Tf (" + b"word " * 60 + b") Tj ET"
    image = dict(more=b"/XObject<</P 6 0 R>>", extra={6: stream(b"x", b"/Subtype/Image")})
    damaged = one_page(b"<</Filter/FlateDecode/Length 4>>\nstream\nabcd\nendstream")
    loop = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[2 0 R 3 0 R]>>", 3: b"<</Type/Page/Contents 3 0 R>>"}
    bomb = one_page(flat(b" " * (pdf.MOST_BYTES + 10)))
    secret = built(one_page(stream(b"")), "/Root 1 0 R/Encrypt 9 0 R")
    df = rows(spark, ("long", built(one_page(stream(long), **image))), ("sparse", built(one_page(stream(b"BT /F1 9 Tf (few) Tj ET"), **image))), ("few", built(one_page(stream(b"BT /F1 9 Tf (few) Tj ET")))), ("none", built(one_page(stream(b""))))
              , ("damaged", built(damaged)), ("loop", built(loop)), ("bomb", built(bomb)), ("secret", secret), ("cut", built(one_page(stream(b"")))[:60]))
    got = {r.path: (r.unit_type, r.status, r.warning) for r in files.file_units(df).collect()}
    assert got["long"] == ("page", "processed", None) and got["few"] == ("page", "processed", None)
    assert got["sparse"] == ("page", "ocr_required", "little text beside pictures") and got["none"] == ("page", "ocr_required", "no text")
    assert got["damaged"][:2] == ("page", "failed") and "damaged" in got["damaged"][2] and got["bomb"][:2] == ("page", "failed") and got["loop"][:2] == ("page", "ocr_required")
    assert got["secret"] == ("broken", "failed", "encrypted") and got["cut"][:2] == ("broken", "failed")


def test_cells_stand_in_their_columns_and_sheets_under_their_names(spark):
    parts = {
        "xl/workbook.xml": f'<workbook xmlns:r="{R[:-1]}"><sheets><sheet name="Second" r:id="b"/><sheet name="First" r:id="a" state="hidden"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="a" Type="{R}worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="b" Type="{R}worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<ws xmlns:r="{R[:-1]}"><row r="2"><c r="A2"><v>x</v></c><c r="C2"><v>B</v></c><c><v>after</v></c></row><hyperlinks><hyperlink ref="A2" r:id="h"/></hyperlinks></ws>',
        "xl/worksheets/sheet2.xml": '<ws><row r="1"><c r="AB1"><v>far</v></c></row></ws>',
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships><Relationship Id="h" Type="{R}hyperlink" Target="https://a.example/" TargetMode="External"/><Relationship Id="d" Type="{R}drawing" Target="../drawings/drawing7.xml"/><Relationship Id="c" Type="{R}comments" Target="../comments9.xml"/></Relationships>',
        "xl/comments9.xml": '<comments><comment ref="A2"><t>why</t></comment></comments>',
        "xl/drawings/drawing7.xml": f'<d xmlns:r="{R[:-1]}"><anchor><from><col>1</col><row>4</row></from><sp><t>in a shape</t></sp></anchor><anchor><chart r:id="z"/></anchor></d>',
        "xl/drawings/_rels/drawing7.xml.rels": f'<Relationships><Relationship Id="z" Type="{R}chart" Target="../charts/chart1.xml"/></Relationships>',
        "xl/charts/chart1.xml": "<c><title><t>Sales</t></title><plotArea><barChart><ser><tx><v>north</v></tx><cat><pt><v>a</v></pt><pt><v>b</v></pt></cat><val><pt><v>1</v></pt><pt><v>2</v></pt></val></ser></barChart></plotArea></c>",
        "xl/media/image1.png": "x",
    }
    got = [(r.unit_type, r.text, r.status, r.location.get("cell"), r.location.get("column")) for r in files.file_units(rows(spark, ("a.bin", ooxml_zip(parts)))).orderBy("ordinal").collect()]
    assert got[0] == ("row", "Second\t" + "\t" * 27 + "far", "processed", None, None)
    assert got[1][:2] == ("row", "First\tx\t\tB\tafter") and got[2] == ("link", "https://a.example/", "processed", "A2", None)
    assert got[3] == ("drawing_shape", "in a shape", "processed", None, "2") and got[4][:3] == ("chart", "Sales\nnorth: a=1, b=2", "partial")
    assert got[5] == ("comment", "A2: why", "processed", "A2", None) and got[6][::2][:2] == ("embedded_image", "ocr_required") and len(got) == 7


def ooxml_zip(parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def test_notes_follow_the_slide_that_points_to_them(spark):
    raw = archives.pptx([("one", ""), ("two", "for two"), ("three", "for three")])
    got = [(r.unit_type, r.text, r.location["slide"]) for r in files.file_units(rows(spark, ("a.pptx", raw))).orderBy("ordinal").collect()]
    assert got == [("slide", "one", "1"), ("slide", "two", "2"), ("notes", "for two", "2"), ("slide", "three", "3"), ("notes", "for three", "3")]


def test_headings_are_paths_and_links_are_kept(spark):
    p = lambda text, style="": f'<p><pPr><pStyle val="{style}"/></pPr><t>{text}</t></p>' if style else f"<p><t>{text}</t></p>"
    body = p("One", "Heading1") + p("a") + p("Two", "Heading2") + p("b") + p("Three", "Heading1") + '<p><hyperlink id="l"><t>c</t></hyperlink></p>'
    raw = ooxml_zip({"word/document.xml": f"<d><body>{body}</body></d>", "word/_rels/document.xml.rels": f'<Relationships><Relationship Id="l" Type="{R}hyperlink" Target="https://b.example/" TargetMode="External"/></Relationships>'})
    got = [(r.unit_type, r.text, r.heading, r.metadata.get("links")) for r in files.file_units(rows(spark, ("a.docx", raw))).orderBy("ordinal").collect()]
    assert [x[:3] for x in got] == [("heading", "One", ["One"]), ("block", "a", ["One"]), ("heading", "Two", ["One", "Two"]), ("block", "b", ["One", "Two"]), ("heading", "Three", ["Three"]), ("block", "c", ["Three"])]
    assert got[-1][3] == "https://b.example/"


def damaged_part(raw, name):
    """The archive with wrong bytes in the middle of one part's data."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        e = z.getinfo(name)
    at = e.header_offset + 30 + len(name) + e.compress_size // 2
    return raw[:at] + b"\xff\xff\xff\xff" + raw[at + 4 :]


def test_bad_archives_give_a_reason_and_the_job_goes_on(spark):
    sound = archives.xlsx([("s", [["a" * 50, "b"]] * 40), ("t", [["c"]])])
    encrypted = bytearray(ooxml_zip({"word/document.xml": "<d/>"}))
    for mark in (b"PK\x03\x04", b"PK\x01\x02"):
        encrypted[encrypted.index(mark) + (6 if mark[2] == 3 else 8)] |= 1
    bomb = ooxml_zip({"word/document.xml": "<d><body>" + "<p/>" * 2_000_000 + "</body></d>"})
    entity = ooxml_zip({"word/document.xml": '<!DOCTYPE d [<!ENTITY a "b">]><d>&a;</d>'})
    many = ooxml_zip({f"x{i}": "" for i in range(ooxml.MOST_ENTRIES + 1)})
    far = ooxml_zip({"xl/worksheets/sheet1.xml": '<ws><row><c r="ZZZZZZ1"><v>1</v></c></row></ws>'})
    df = rows(spark, ("damaged.xlsx", damaged_part(sound, "xl/worksheets/sheet1.xml")), ("e.docx", bytes(encrypted)), ("bomb.docx", bomb), ("entity.docx", entity), ("many.docx", many), ("far.xlsx", far), ("cut.docx", sound[:-30]), ("ok.xlsx", sound))
    got = {}
    for r in files.file_units(df).orderBy("path", "ordinal").collect():
        got.setdefault(r.path, []).append((r.unit_type, r.status, r.warning))
    assert got["damaged.xlsx"][0][:2] == ("part", "failed") and got["damaged.xlsx"][1] == ("row", "processed", None)
    assert all(got[k][0][:2] == ("part", "failed") and got[k][0][2] for k in ("e.docx", "bomb.docx", "entity.docx", "far.xlsx"))
    assert got["many.docx"][0][:2] == ("broken", "failed") and got["cut.docx"][0][:2] == ("broken", "failed") and len(got["ok.xlsx"]) == 41


def test_archives_are_found_by_their_parts(spark):
    assert [r.text for r in files.file_units(rows(spark, ("noname", archives.docx("T", ["x"])))).orderBy("ordinal").collect()] == ["T", "x"]


def test_files_are_written_once_and_read_as_units(spark, tmp_path):
    units.register(spark)
    where = str(tmp_path / "out")
    named = [("a/one.txt", b"l1\nl2"), ("two.docx", archives.docx("T", ["x"])), ("three.pdf", archives.pdf([["p1"], ["p2"], ["p3"]]))]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in named], "name string, content binary")
    df.write.format("folioflow_files").mode("append").save(where)
    assert sorted(str(x.relative_to(where)) for x in (tmp_path / "out").rglob("*") if x.is_file()) == ["a/one.txt", "three.pdf", "two.docx"]
    (tmp_path / "out" / "_hidden").write_bytes(b"no")
    got = spark.read.format("folioflow_units").load(where)
    want = {("one.txt", 0, "l1"), ("one.txt", 1, "l2"), ("two.docx", 0, "T"), ("two.docx", 1, "x"), ("three.pdf", 0, "p1"), ("three.pdf", 1, "p2"), ("three.pdf", 2, "p3")}
    assert {(r.path.rsplit("/", 1)[-1], r.ordinal, r.text) for r in got.collect()} == want
    # three tasks share the pages of a PDF that is over the bound
    split = spark.read.format("folioflow_units").option("partitionBytes", 300).load(where)
    assert split.rdd.getNumPartitions() > 4 and {(r.path.rsplit("/", 1)[-1], r.ordinal, r.text) for r in split.collect()} == want
    for bad in ("../up", "/top", "a//b", ""):
        with pytest.raises(Exception, match="no name of a file"):
            spark.createDataFrame([(bad, bytearray(b"x"))], "name string, content binary").write.format("folioflow_files").mode("append").save(where)
    with pytest.raises(Exception, match="one name"):
        spark.createDataFrame([("x", bytearray(b"x"))] * 2, "name string, content binary").write.format("folioflow_files").mode("append").save(where)
    spark.createDataFrame([("only", bytearray(b"x"))], "name string, content binary").write.format("folioflow_files").mode("overwrite").save(where)
    assert [x.name for x in (tmp_path / "out").rglob("*") if x.is_file()] == ["only"]


def test_filters_reach_the_source(spark, tmp_path):
    units.register(spark)
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.pdf").write_bytes(archives.pdf([["y"]]))
    read = spark.read.format("folioflow_units").load(str(tmp_path))
    assert [r.text for r in read.where("kind = 'pdf'").collect()] == ["y"]
    assert [r.text for r in read.where("kind in ('text', 'zip') and text = 'x'").collect()] == ["x"]
    assert [r.text for r in read.where(F.col("path").endswith("a.txt")).collect()] == ["x"]
    plan = read.where("kind = 'pdf'")._jdf.queryExecution().executedPlan().toString()
    assert "kind = pdf" not in plan.split("BatchScan")[0]  # no filter is left above the scan
    reader = units.UnitsReader(None, {"path": str(tmp_path)})
    assert [len(p.files) for p in reader.partitions()] == [2] and units.planned([("a", 5), ("b", 5), ("c.pdf", 25), ("d", 90)], 10) == [[("c.pdf", 0, 3)], [("c.pdf", 1, 3)], [("c.pdf", 2, 3)], [("a", 0, 1), ("b", 0, 1)], [("d", 0, 1)]]
