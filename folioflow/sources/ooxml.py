"""Office archives as units: parts are found through relationships, cells by their references, and every read is bounded."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

#: Bounds of an archive.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 2_000, 512 << 20, 100.0
#: Small parts may shrink further than the ratio without harm.
SMALL = 1 << 20
#: What reading a damaged, encrypted or oversized archive or part can raise.
UNREADABLE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, KeyError, ValueError, OSError, struct.error, ElementTree.ParseError, IndexError)
#: Parts of a word-processing archive beside its body, and their unit types.
WORD_PARTS = {"header": "header", "footer": "footer", "footnotes": "footnote", "endnotes": "endnote", "comments": "comment"}


class Unit(NamedTuple):
    """One unit of a file; place and more are what tells where it stands and what else is known."""

    kind: str
    text: str | None
    status: str = ""
    heading: tuple[str, ...] = ()
    place: dict[str, str] = {}
    more: dict[str, str] = {}
    warning: str | None = None


def local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def below(e: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if local(x) in names)


def text_of(e: ElementTree.Element) -> str:
    """The text runs below an element."""
    return "".join(t.text or "" for t in below(e, "t"))


def attribute(e: ElementTree.Element, name: str) -> str | None:
    """An attribute by its name without namespace."""
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


class Package:
    """Parts of an archive; all that is read counts against one bound."""

    def __init__(self, raw: bytes, most_bytes: int = MOST_BYTES):
        self._zip = zipfile.ZipFile(io.BytesIO(raw))
        self._entries = {e.filename: e for e in self._zip.infolist()}
        if len(self._entries) > MOST_ENTRIES:
            raise ValueError(f"{len(self._entries)} entries")
        self._left = most_bytes
        self.names = sorted(self._entries)

    def __contains__(self, part: str) -> bool:
        return part in self._entries

    def size(self, part: str) -> int:
        return self._entries[part].file_size

    def read(self, part: str) -> bytes:
        """The bytes of a part, whatever its entry says of their number."""
        entry = self._entries[part]
        most = min(self._left, max(SMALL, int(MOST_RATIO * entry.compress_size)))
        with self._zip.open(entry) as f:
            data = f.read(most + 1)
        if len(data) > most:
            raise ValueError(f"{part} unpacks to over {most} bytes")
        self._left -= len(data)
        return data

    def xml(self, part: str) -> ElementTree.Element:
        data = self.read(part)
        if b"<!DOCTYPE" in data[:4096]:
            raise ValueError(f"{part} declares a document type")
        return ElementTree.fromstring(data)

    def related(self, part: str) -> dict[str, tuple[str, str]] | None:
        """Last word of the type, and target, by id: a part's path, or an external target as it stands; null without a relationships part."""
        rels = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
        if rels not in self:
            return None
        found = {}
        for e in below(self.xml(rels), "Relationship"):
            target = e.get("Target") or ""
            if e.get("TargetMode") != "External":
                target = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(part), target))
            found[e.get("Id") or ""] = ((e.get("Type") or "").rsplit("/", 1)[-1], target)
        return found

    def of_type(self, part: str, kind: str) -> list[str]:
        return [t for k, t in (self.related(part) or {}).values() if k == kind and t in self]


def _number(part: str) -> int:
    return int("".join(filter(str.isdigit, part.rsplit("/", 1)[-1])) or 0)


def _tried(part: str, units) -> Iterator[Unit]:
    """The units of a part; if it can't be read, one that says so, and the other parts go on."""
    try:
        yield from list(units())
    except UNREADABLE as e:
        yield Unit("part", None, "failed", place={"part": part}, warning=str(e) or type(e).__name__)


def _links(e: ElementTree.Element, related: dict[str, tuple[str, str]]) -> dict[str, str]:
    targets = sorted({related[i][1] for x in below(e, "hyperlink", "hlinkClick") if (i := attribute(x, "id")) in related})
    return {"links": " ".join(targets)} if targets else {}


def _pictures(package: Package, folder: str) -> Iterator[Unit]:
    for part in package.names:
        if part.startswith(folder) and not part.endswith("/"):
            yield Unit("embedded_image", None, "ocr_required", place={"part": part}, more={"size": str(package.size(part))})


def word(package: Package) -> Iterator[Unit]:
    """Blocks and table rows in the body's order under their headings, then headers, footers, notes and comments by part, then pictures."""
    main = "word/document.xml"

    def body() -> Iterator[Unit]:
        root, related = package.xml(main), package.related(main) or {}
        headings: list[str] = []
        tables = 0
        for e in next(below(root, "body"), root):
            if local(e) == "p":
                text = text_of(e)
                style = next((attribute(x, "val") or "" for x in below(e, "pStyle")), "")
                level = style.lower().removeprefix("heading").strip()
                more = _links(e, related) | ({"style": style} if style else {})
                if text.strip() and style.lower().startswith("heading") and level.isdigit():
                    headings[max(0, int(level) - 1) :] = [" ".join(text.split())]
                    yield Unit("heading", text, heading=tuple(headings), more=more)
                else:
                    yield Unit("block", text, heading=tuple(headings), more=more)
            elif local(e) == "tbl":
                tables += 1
                for i, row in enumerate((r for r in e if local(r) == "tr"), 1):
                    cells = [text_of(c) for c in row if local(c) == "tc"]
                    yield Unit("table_row", "\t".join(cells), heading=tuple(headings), place={"table": str(tables), "row": str(i)}, more=_links(row, related))

    if main in package:
        yield from _tried(main, body)
    for part in package.names:
        name = part.rsplit("/", 1)[-1].removesuffix(".xml")
        kind = WORD_PARTS.get(name.rstrip("0123456789"))
        if part.startswith("word/") and part.endswith(".xml") and "/_rels/" not in part and kind:

            def notes(part=part, kind=kind) -> Iterator[Unit]:
                root = package.xml(part)
                own = [e for e in root if local(e) == kind] if kind in ("footnote", "endnote", "comment") else [root]
                yield from (Unit(kind, text, place={"part": part}) for text in map(text_of, own) if text)

            yield from _tried(part, notes)
    yield from _pictures(package, "word/media/")


def slides(package: Package) -> Iterator[Unit]:
    """Slides in the presentation's order (by number without its relationships), each with the notes that it points to."""
    main = "ppt/presentation.xml"
    related = (package.related(main) if main in package else None) or {}
    listed = [related[i][1] for e in below(package.xml(main), "sldId") if (i := attribute_r(e)) in related] if related else []
    listed += sorted((n for n in package.names if n.startswith("ppt/slides/slide") and n.endswith(".xml") and n not in listed), key=_number)
    for i, part in enumerate(listed, 1):
        place = {"slide": str(i), "part": part}

        def slide(part=part, place=place) -> Iterator[Unit]:
            root, own = package.xml(part), package.related(part)
            shown = sum(1 for _ in below(root, "pic", "graphicFrame"))
            yield Unit("slide", text_of(root), place=place, more=_links(root, own or {}) | ({"visuals": str(shown)} if shown else {}))
            notes = package.of_type(part, "notesSlide") if own is not None else [n for n in [f"ppt/notesSlides/notesSlide{_number(part)}.xml"] if n in package]
            for n in notes:
                if text := text_of(package.xml(n)):
                    yield Unit("notes", text, place=place | {"part": n})

        yield from _tried(part, slide)
    yield from _pictures(package, "ppt/media/")


def attribute_r(e: ElementTree.Element) -> str | None:
    """The relationship's id, which has a namespace where a plain id stands beside it."""
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), e.get("id"))


def column_of(reference: str) -> int | None:
    """Place of a cell's column from its reference, A is 0."""
    letters = reference.rstrip("0123456789")
    if not letters or not letters.isascii() or not letters.isalpha():
        return None
    at = 0
    for c in letters.upper():
        at = at * 26 + ord(c) - 64
    return at - 1


#: Columns that a sheet has at most; a cell beyond can't stand in it.
MOST_COLUMNS = 16_384


def _cells(row: ElementTree.Element, shared: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Values by column, gaps empty, and formulas by reference."""
    values: list[str] = []
    formulas = []
    for cell in (e for e in row if local(e) == "c"):
        own = next((v.text or "" for v in cell if local(v) == "v"), None)
        value = text_of(cell) if own is None else own
        if cell.get("t") == "s" and value.isdigit() and int(value) < len(shared):
            value = shared[int(value)]
        at = column_of(cell.get("r") or "")
        at = len(values) if at is None else at
        if at >= MOST_COLUMNS:
            raise ValueError(f"no column is {cell.get('r')}")
        values += [""] * (at + 1 - len(values))
        values[at] = value
        formula = next((v.text or "" for v in cell if local(v) == "f"), None)
        if formula:
            formulas.append((cell.get("r") or "", formula))
    return values, formulas


def sheets(package: Package) -> Iterator[Unit]:
    """Rows under their sheet's name with each value in its column, formulas and merged ranges, links and comments of the sheet, texts of shapes, charts, pictures."""
    shared = [text_of(e) for e in package.xml("xl/sharedStrings.xml") if local(e) == "si"] if "xl/sharedStrings.xml" in package else []
    main = "xl/workbook.xml"
    listed = [(e.get("name") or "", attribute_r(e), e.get("state") or "visible") for e in below(package.xml(main), "sheet")] if main in package else []
    related = package.related(main) if main in package else None
    found = sorted((n for n in package.names if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=_number)
    if related is not None:
        placed = [(name, related[i][1], state) for name, i, state in listed if i in related]
    else:  # an archive without relationships lists its sheets in the order of their parts
        placed = [(listed[k][0] if k < len(listed) else f"sheet{k + 1}", part, "visible") for k, part in enumerate(found)]
    commented: set[str] = set()
    for name, part, state in placed:
        where = {"sheet": name, "part": part} | ({"hidden": state} if state != "visible" else {})

        def sheet(name=name, part=part, where=where) -> Iterator[Unit]:
            root, own = package.xml(part), package.related(part) or {}
            for k, row in enumerate(below(root, "row"), 1):
                values, formulas = _cells(row, shared)
                for ref, formula in formulas:
                    yield Unit("formula", f"{name}!{ref}={formula}", heading=(name,), place=where | {"cell": ref})
                yield Unit("row", "\t".join([name, *values]), heading=(name,), place=where | {"row": row.get("r") or str(k)})
            yield from (Unit("merged", f"{name}!{e.get('ref') or ''}", heading=(name,), place=where) for e in below(root, "mergeCell"))
            for e in below(root, "hyperlink"):
                target = own.get(attribute(e, "id") or "", ("", e.get("location") or ""))[1]
                yield Unit("link", target, heading=(name,), place=where | {"cell": e.get("ref") or ""})
            for kind, target in own.values():
                if target in package and kind == "comments":
                    commented.add(target)
                    yield from (Unit("comment", f"{e.get('ref') or ''}: {text_of(e)}", heading=(name,), place=where | {"cell": e.get("ref") or ""}) for e in below(package.xml(target), "comment"))
                elif target in package and kind == "drawing":
                    yield from _drawing(package, target, where)

        yield from _tried(part, sheet)
    for part in package.names:
        if part.startswith("xl/comments") and part not in commented:
            yield from _tried(part, lambda part=part: (Unit("comment", f"{e.get('ref') or ''}: {text_of(e)}", place={"part": part}) for e in below(package.xml(part), "comment")))
    yield from _pictures(package, "xl/media/")


def _drawing(package: Package, part: str, where: dict[str, str]) -> Iterator[Unit]:
    """Texts of a sheet's shapes and its charts, each with the cell that it is fixed to; without one it is partial."""
    related = package.related(part) or {}
    for anchor in package.xml(part):
        corner = next(below(anchor, "from"), None)
        at = {local(x): (x.text or "").strip() for x in corner} if corner is not None else {}
        place = where | {"part": part} | ({"row": str(int(at["row"]) + 1), "column": str(int(at["col"]) + 1)} if at.get("row", "").isdigit() and at.get("col", "").isdigit() else {})
        status = "" if "column" in place else "partial"
        for shape in below(anchor, "sp"):
            if text := text_of(shape).strip():
                yield Unit("drawing_shape", text, status, heading=(where["sheet"],), place=place)
        for chart in below(anchor, "chart"):
            kind, target = related.get(attribute(chart, "id") or "", ("", ""))
            if kind == "chart" and target in package:
                yield _chart(package.xml(target), place | {"part": target}, status, where["sheet"])


def _chart(root: ElementTree.Element, place: dict[str, str], status: str, sheet: str) -> Unit:
    """A chart's title and its series: name, categories and values as last stored in the file."""
    plot = next(below(root, "plotArea"), root)
    kind = next((local(e) for e in plot if local(e).endswith("Chart")), "")
    title = next((text_of(e) for e in below(root, "title")), "")
    points = lambda e: [v.text or "" for v in below(e, "v")]
    lines = []
    for series in below(plot, "ser"):
        parts = {local(e): points(e) for e in series if local(e) in ("tx", "cat", "val", "xVal", "yVal")}
        name, cats, vals = " ".join(parts.get("tx", [])), parts.get("cat") or parts.get("xVal") or [], parts.get("val") or parts.get("yVal") or []
        lines.append(f"{name}: " + ", ".join(f"{c}={v}" for c, v in zip(cats, vals, strict=False)) if cats else f"{name}: " + ", ".join(vals))
    return Unit("chart", "\n".join([title, *lines]) if title else "\n".join(lines), status if kind and lines else "partial", heading=(sheet,), place=place, more={"chart": kind, "series": str(len(lines))})


READERS = {"docx": word, "pptx": slides, "xlsx": sheets}
#: The part that tells an archive's kind whatever its name.
MAIN_PARTS = {"word/document.xml": "docx", "ppt/presentation.xml": "pptx", "xl/workbook.xml": "xlsx"}


def kind_of(name: str, names: list[str]) -> str | None:
    """What an archive is by its parts, else by its name; null for other archives."""
    found = next((k for part, k in MAIN_PARTS.items() if part in names), None)
    by_name = name.rsplit(".", 1)[-1].lower()
    return found or (by_name if by_name in READERS else None)


def units(name: str, raw: bytes) -> Iterator[Unit]:
    """Units of an office archive; one unit `broken` for an archive that can't be read, nothing for other archives."""
    try:
        package = Package(raw)
        kind = kind_of(name, package.names)
        found = list(READERS[kind](package)) if kind else []
    except UNREADABLE as e:
        found = [Unit("broken", "", "failed", warning=str(e) or type(e).__name__)]
    yield from found
