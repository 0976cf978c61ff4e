"""Word documents: parts of the package, paragraphs, table cells, footnotes and references between notes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

# --- Fixed values -----------------------------------------------------------------------------------

MOST_PACKAGE, MOST_PARTS, MOST_PART, MOST_TOTAL = 16 << 20, 2048, 32 << 20, 96 << 20
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
QUOTES = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', " ": " "})
NUMBERED_SUPRA = re.compile(r"(?i)(supra)[^\n\r  ]{0,40}?[0-9]+")

# ----------------------------------------------------------------------------------------------------


class Refused(ValueError):
    """A package that breaks a rule."""


def read_parts(content: bytes, wanted: tuple[str, ...] | None = None) -> dict[str, bytes]:
    """Parts of a package by name; refuses unsafe names, repeated parts and sizes over the limits."""
    if len(content) > MOST_PACKAGE:
        raise Refused("package too large")
    parts: dict[str, bytes] = {}
    total = 0
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        infos = package.infolist()
        if len(infos) > MOST_PARTS:
            raise Refused("too many parts")
        for info in infos:
            name = info.filename
            if name.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", name) or ":" in name:
                raise Refused("unsafe part name")
            if name in parts:
                raise Refused("repeated part")
            total += info.file_size
            if info.file_size > MOST_PART or total > MOST_TOTAL:
                raise Refused("part too large")
            if not info.is_dir() and (wanted is None or name in wanted):
                parts[name] = package.read(info)
    return parts


def write_parts(parts: dict[str, bytes]) -> bytes:
    """A package with the parts in order, without time stamps."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, body in parts.items():
            package.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def accepted_text(element: ElementTree.Element) -> str:
    """Text of an element as accepted: deletions are passed over, tabs and breaks become white space."""
    out = []
    for e in element:
        if e.tag in (f"{W}del", f"{W}moveFrom"):
            continue
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
        else:
            out.append(accepted_text(e))
    return "".join(out)


def normal(text: str) -> str:
    return text.translate(QUOTES)


def body_paragraphs(xml: bytes) -> list[dict]:
    """Paragraphs of the body with their style, note references and table cell (row, column, spans) if any."""
    root = ElementTree.fromstring(xml)
    body = root.find(f"{W}body")
    out: list[dict] = []

    def paragraph(p, cell):
        style = p.find(f"{W}pPr/{W}pStyle")
        refs = [int(r.get(f"{W}id", "0")) for r in p.iter(f"{W}footnoteReference")]
        out.append({"seq": len(out), "text": normal(accepted_text(p)), "style": style.get(f"{W}val") if style is not None else None, "notes": refs, "cell": cell})

    def walk(parent):
        for e in parent:
            if e.tag == f"{W}p":
                paragraph(e, None)
            elif e.tag == f"{W}tbl":
                for r, row in enumerate(e.findall(f"{W}tr")):
                    column = 0
                    for tc in row.findall(f"{W}tc"):
                        span = tc.find(f"{W}tcPr/{W}gridSpan")
                        merge = tc.find(f"{W}tcPr/{W}vMerge")
                        width = int(span.get(f"{W}val", "1")) if span is not None else 1
                        cell = {"row": r, "column": column, "columns": width, "continues": merge is not None and merge.get(f"{W}val") != "restart"}
                        for p in tc.iter(f"{W}p"):
                            paragraph(p, cell)
                        column += width
            elif e.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}customXml"):
                walk(e)

    if body is not None:
        walk(body)
    return out


def footnote_texts(xml: bytes | None) -> dict[int, str]:
    """Texts of the notes by id, without separators."""
    if not xml:
        return {}
    notes = ElementTree.fromstring(xml).findall(f"{W}footnote")
    return {int(n.get(f"{W}id", "0")): normal("\n".join(accepted_text(p) for p in n.iter(f"{W}p"))) for n in notes if n.get(f"{W}type") in (None, "normal")}


def text_units(content: bytes) -> list[dict]:
    """Body paragraphs, then the footnotes in order of their first reference, numbered from 1."""
    parts = read_parts(content, ("word/document.xml", "word/footnotes.xml"))
    if "word/document.xml" not in parts:
        raise Refused("no document part")
    body = body_paragraphs(parts["word/document.xml"])
    notes = footnote_texts(parts.get("word/footnotes.xml"))
    order = list(dict.fromkeys(n for p in body for n in p["notes"] if n in notes))
    number = {n: i + 1 for i, n in enumerate(order)}
    units = [{"kind": "body", "number": p["seq"] + 1, "text": p["text"], "references": [number[n] for n in p["notes"] if n in number]} for p in body]
    return units + [{"kind": "footnote", "number": number[n], "text": notes[n], "references": [number[n]]} for n in order]


def numbered_supra(text: str) -> bool:
    return bool(NUMBERED_SUPRA.search(text))


def paragraphs_under(element: ElementTree.Element) -> list[ElementTree.Element]:
    """The outermost paragraphs at or below an element, in order; a paragraph inside one of them is not listed."""
    if element.tag == f"{W}p":
        return [element]
    return [p for child in element for p in paragraphs_under(child)]


def with_bookmarks(xml: bytes, references: list[int], ordinals: set[int], prefix: str = "SupraNote") -> tuple[bytes, dict[int, str], int]:
    """A document part with a bookmark round the run that first refers to each note asked for.

    references: note ids in order of their numbers; ordinals: the numbers asked for, from 1. Gives the part, the
    names of the bookmarks that are there, and how many were added. A name that the part has already stays; a number
    without a reference gets no name.
    """
    ElementTree.register_namespace("w", W.strip("{}"))
    root = ElementTree.fromstring(xml)
    starts = list(root.iter(f"{W}bookmarkStart"))
    known = {e.get(f"{W}name") for e in starts}
    free = max((int(e.get(f"{W}id", "0")) for e in starts), default=0) + 1
    targets: dict[int, tuple[ElementTree.Element, ElementTree.Element]] = {}
    for parent in root.iter():
        for run in parent:
            if run.tag == f"{W}r":
                for reference in run.iter(f"{W}footnoteReference"):
                    targets.setdefault(int(reference.get(f"{W}id", "0")), (parent, run))
    names, added = {}, 0
    for ordinal in sorted(ordinals):
        if not 1 <= ordinal <= len(references):
            continue
        name = f"{prefix}{ordinal}"
        if name not in known:
            if references[ordinal - 1] not in targets:
                continue
            parent, run = targets[references[ordinal - 1]]
            at = list(parent).index(run)
            parent.insert(at, ElementTree.Element(f"{W}bookmarkStart", {f"{W}id": str(free), f"{W}name": name}))
            parent.insert(at + 2, ElementTree.Element(f"{W}bookmarkEnd", {f"{W}id": str(free)}))
            free, added = free + 1, added + 1
        names[ordinal] = name
    return ElementTree.tostring(root, encoding="utf-8", xml_declaration=True), names, added


def read_units(files: DataFrame) -> DataFrame:
    """Units of Word files (path, content): path, kind, number, text, references, fault (of a refused file)."""
    unit = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("text", pa.string()), ("references", pa.list_(pa.int32()))]))

    def rows(batches):
        for batch in batches:
            made, faults = [], []
            for content in batch.column("content").to_pylist():
                try:
                    made.append(text_units(content))
                    faults.append(None)
                except (Refused, zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    made.append([])
                    faults.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, unit), pa.array(faults, pa.string())], names=["path", "units", "fault"])

    from pyspark.sql import functions as F

    told = files.select("path", "content").mapInArrow(rows, "path string, units array<struct<kind:string,number:int,text:string,references:array<int>>>, fault string")
    return told.select("path", "fault", F.inline_outer("units"))
