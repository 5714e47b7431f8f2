"""Rows as office archives and PDF files: the plainest file of each format that holds given texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def _zip(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8"?>{text}', zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def _rels(*targets: tuple[str, str]) -> str:
    """A relationships part; ids are r1, r2 and so on."""
    inner = "".join(f'<Relationship Id="r{i}" Type="{_TYPE}{kind}" Target={quoteattr(target)}/>' for i, (kind, target) in enumerate(targets, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def docx(title: str, texts: Sequence[str]) -> bytes:
    """A heading, and a paragraph for each text."""
    run = lambda text, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'
    head = run(title, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>')
    return _zip({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{head}{"".join(map(run, texts))}</w:body></w:document>'})


def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def xlsx(sheets: Sequence[tuple[str, Sequence[Sequence[str | None]]]]) -> bytes:
    """Sheets of rows; as other programs do, a null cell isn't stored, so those after it are known by their references."""
    parts, names = {}, ""
    for k, (name, rows) in enumerate(sheets, 1):
        cells = lambda i, row: "".join(f'<c r="{_letters(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(row) if v is not None)
        body = "".join(f'<row r="{i}">{cells(i, row)}</row>' for i, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'
        names += f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="r{k}"/>'
    book = f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_TYPE[:-1]}"><sheets>{names}</sheets></workbook>'
    return _zip({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": _rels(*[("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)]), **parts})


def pptx(slides: Sequence[tuple[str, str]]) -> bytes:
    """A slide for each (text, notes); notes parts are numbered among themselves, so only relationships pair them."""
    text = lambda tag, x: f'<p:{tag} xmlns:p="p" xmlns:a="a"><a:t>{escape(x)}</a:t></p:{tag}>'
    parts, n = {}, 0
    for i, (shown, notes) in enumerate(slides, 1):
        parts[f"ppt/slides/slide{i}.xml"] = text("sld", shown)
        own = []
        if notes:
            n += 1
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = text("notes", notes)
            own = [("notesSlide", f"../notesSlides/notesSlide{n}.xml")]
        parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = _rels(*own)
    listed = "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(1, len(slides) + 1))
    main = f'<p:presentation xmlns:p="p" xmlns:r="{_TYPE[:-1]}"><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>'
    return _zip({"ppt/presentation.xml": main, "ppt/_rels/presentation.xml.rels": _rels(*[("slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)]), **parts})


def pdf(pages: Sequence[Sequence[str]]) -> bytes:
    """A page for each list of lines, in characters of Latin-1; others become question marks."""
    import zlib

    quoted = lambda x: x.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>"]
    kids = []
    for lines in pages:
        content = zlib.compress(b"BT /F1 9 Tf 12 TL 40 800 Td " + b" ".join(b"(" + quoted(x) + b") Tj T*" for x in lines) + b" ET")
        objects.append(b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(content), content))
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, x in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, x)
    table = b"".join(b"%010d 00000 n \n" % at for at in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
