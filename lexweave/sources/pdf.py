"""PDF files to pages and lines: a small reader of text in simple and composite fonts, without other libraries.

It reads objects wherever they stand (so a damaged cross-reference table does no harm), Flate streams, object
streams, inherited page attributes, text positions, encodings and ToUnicode maps. It draws nothing: a page
with no text is reported as one that needs recognition. Encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------

DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)
MOST_PARENTS = 32
#: In ems: a line goes on within this height, a word within this gap, a line within this jump.
SAME_LINE, WORD_GAP, SAME_ROW_GAP = 0.55, 0.15, 1.5
RAISED, SMALL = 0.15, 0.82
DEFAULT_WIDTH = 500

# ----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(rb"[\x00\t\n\f\r ]*(?:%[^\r\n]*[\x00\t\n\f\r ]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|[^\x00\t\n\f\r ()<>\[\]{}/%]+|[{}])")
_OBJECT = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_BLANKS = b"\x00\t\n\f\r "


class Name(str):
    """A PDF name."""


class Ref(int):
    """A reference to an object, by its number."""


class Refused(ValueError):
    """A file that is not read."""


class Reader:
    """Values of PDF syntax from a position on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        m = _TOKEN.match(self.data, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[1]

    def string(self) -> bytes:
        out, depth, data = bytearray(), 1, self.data
        while self.at < len(data):
            c = data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                n = data[self.at : self.at + 1]
                octal = re.compile(rb"[0-7]{1,3}").match(data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                self.at += 1
                if n == b"\r" and data[self.at : self.at + 1] == b"\n":
                    self.at += 1
                if n not in (b"\r", b"\n"):
                    out += _ESCAPES.get(n, n)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)

    def value(self):
        """The next value; operators and keywords are bytes, the end is None."""
        t = self.token()
        if t is None:
            return None
        if t == b"<<":
            out = {}
            while (key := self.value()) not in (b">>", None):
                out[str(key)] = self.value()
            return out
        if t == b"[":
            items = []
            while (item := self.value()) not in (b"]", None):
                items.append(item)
            return items
        if t == b"(":
            return ("s", self.string())
        if t[:1] == b"<" and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            return ("s", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if re.fullmatch(rb"[+-]?\d+", t):
            m = re.compile(rb"[\x00\t\n\f\r ]+\d+[\x00\t\n\f\r ]+R(?![A-Za-z])").match(self.data, self.at)
            if m and t[:1].isdigit():
                self.at = m.end()
                return Ref(t)
            return int(t)
        if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", t):
            return float(t)
        return {b"true": True, b"false": False}.get(t, t)


class Document:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Refused("no signature")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, tuple[dict, bytes]] = {}
        self.root: Ref | None = None
        for m in _OBJECT.finditer(data):
            self._object(data, int(m[1]), m.end())
        for number in list(self.streams):
            if self.streams[number][0].get("Type") == "ObjStm":
                self._packed(number)
        for m in re.finditer(rb"trailer", data):
            self._trailer(Reader(data, m.end()).value())
        for head, _ in self.streams.values():
            if head.get("Type") == "XRef":
                self._trailer(head)
        if self.root is None:
            self.root = next((Ref(n) for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)

    def _trailer(self, head) -> None:
        if isinstance(head, dict):
            if "Encrypt" in head:
                raise Refused("encrypted")
            if isinstance(head.get("Root"), Ref):
                self.root = head["Root"]

    def _object(self, data: bytes, number: int, at: int) -> None:
        reader = Reader(data, at)
        value = reader.value()
        m = re.compile(rb"[\x00\t\n\f\r ]*stream(\r\n|\n|\r)").match(data, reader.at)
        if isinstance(value, dict) and m:
            size = value.get("Length")
            end = m.end() + size if isinstance(size, int) and not isinstance(size, Ref) else -1
            if end < 0 or not data[end : end + 20].lstrip(_BLANKS).startswith(b"endstream"):
                end = data.find(b"endstream", m.end())
            self.streams[number] = (value, data[m.end() : end if end >= 0 else len(data)])
        self.objects[number] = value

    def _packed(self, number: int) -> None:
        body = self.stream(Ref(number))
        head = self.streams[number][0]
        reader = Reader(body)
        places = [(reader.value(), reader.value()) for _ in range(self.get(head.get("N"), 0))]
        for n, offset in places:
            if isinstance(n, int) and isinstance(offset, int):
                self.objects.setdefault(n, Reader(body, self.get(head.get("First"), 0) + offset).value())

    def get(self, value, default=None):
        """The value that a reference names."""
        for _ in range(MOST_PARENTS):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value))
        return default if value is None else value

    def stream(self, ref) -> bytes:
        """A stream's decoded bytes; of an unknown filter none."""
        if not isinstance(ref, Ref) or int(ref) not in self.streams:
            return b""
        head, body = self.streams[int(ref)]
        filters = self.get(head.get("Filter"), [])
        for name in filters if isinstance(filters, list) else [filters]:
            if name in ("FlateDecode", "Fl"):
                tool = zlib.decompressobj()
                try:
                    body = tool.decompress(body)
                except zlib.error:
                    return b""
            elif name in ("ASCIIHexDecode", "AHx"):
                body = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", body).decode())
            else:
                return b""
        parms = self.get(head.get("DecodeParms"), {})
        if isinstance(parms, dict) and self.get(parms.get("Predictor"), 1) >= 10:
            body = _unpredicted(body, self.get(parms.get("Columns"), 1))
        return body

    def pages(self) -> list[dict]:
        """Page dictionaries in order with the attributes they inherit."""
        out: list[dict] = []
        root = self.get(self.root, {})

        def walk(node, inherited, depth):
            node = self.get(node, {})
            if not isinstance(node, dict) or depth > MOST_PARENTS or len(out) > 100_000:
                return
            held = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"], []):
                    walk(kid, held, depth + 1)
            else:
                out.append(held | node)

        walk(root.get("Pages") if isinstance(root, dict) else None, {}, 0)
        return out

    def label_rules(self) -> list[dict]:
        """Rules of the page-label tree: first, style, prefix, start."""
        out = []

        def walk(node, depth):
            node = self.get(node, {})
            if not isinstance(node, dict) or depth > MOST_PARENTS:
                return
            numbers = self.get(node.get("Nums"), [])
            for k in range(0, len(numbers) - 1, 2):
                spec = self.get(numbers[k + 1], {})
                prefix = spec.get("P")
                out.append({"first": numbers[k], "style": str(spec.get("S", "")), "prefix": _text(prefix[1]) if isinstance(prefix, tuple) else "", "start": self.get(spec.get("St"), 1)})
            for kid in self.get(node.get("Kids"), []):
                walk(kid, depth + 1)

        root = self.get(self.root, {})
        walk(root.get("PageLabels") if isinstance(root, dict) else None, 0)
        return out


def _unpredicted(body: bytes, columns: int) -> bytes:
    """PNG predictors 0 to 2 undone for one byte a pixel."""
    out, before = bytearray(), bytearray(columns)
    for k in range(0, len(body) - columns, columns + 1):
        row = bytearray(body[k + 1 : k + 1 + columns])
        for i in range(columns):
            row[i] = row[i] + (before[i] if body[k] == 2 else row[i - 1] if body[k] == 1 and i else 0) & 255
        out += row
        before = row
    return bytes(out)


def _text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


class Font:
    """Characters and widths of a font's codes."""

    def __init__(self, doc: Document, spec: dict):
        self.name = str(spec.get("BaseFont", ""))
        self.wide = spec.get("Subtype") == "Type0"
        self.map = _unicode_map(doc.stream(spec.get("ToUnicode")))
        self.first = doc.get(spec.get("FirstChar"), 0)
        self.widths = [doc.get(w, DEFAULT_WIDTH) for w in doc.get(spec.get("Widths"), [])]
        encoding = doc.get(spec.get("Encoding"), {})
        self.differences: dict[int, str] = {}
        if isinstance(encoding, dict):
            code = 0
            for item in doc.get(encoding.get("Differences"), []):
                if isinstance(item, Name):
                    if len(item) == 1:
                        self.differences[code] = str(item)
                    elif m := re.fullmatch("uni([0-9A-F]{4})", item):
                        self.differences[code] = chr(int(m[1], 16))
                    code += 1
                elif isinstance(item, int):
                    code = item

    def decode(self, raw: bytes) -> list[tuple[str, float, bool]]:
        """(character, width in ems, is it a one-byte space) of each code."""
        out = []
        for k in range(0, len(raw), 2 if self.wide else 1):
            code = int.from_bytes(raw[k : k + 2], "big") if self.wide else raw[k]
            char = self.map.get(code) or self.differences.get(code) or ("" if self.wide else bytes([code]).decode("cp1252", "replace"))
            at = code - self.first
            width = self.widths[at] if not self.wide and 0 <= at < len(self.widths) else DEFAULT_WIDTH
            out.append((char, width / 1000, code == 32 and not self.wide))
        return out


def _unicode_map(body: bytes) -> dict[int, str]:
    """Codes to characters of a ToUnicode map."""
    out: dict[int, str] = {}
    word = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{2})*)>", block):
            out[int(a, 16)] = word(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{2})+)>", block):
            base = word(c)
            for k in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[int(a, 16) + k] = base[:-1] + chr(ord(base[-1]) + k)
    return out


def _times(m, n):
    """The product of two affine maps (a, b, c, d, e, f), m first."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def glyph_runs(doc: Document, page: dict) -> list[dict]:
    """Shown strings of a page with their place, size and font, in drawing order."""
    resources = doc.get(page.get("Resources"), {})
    fonts = {k: Font(doc, doc.get(v, {})) for k, v in doc.get(resources.get("Font"), {}).items()} if isinstance(resources, dict) else {}
    contents = page.get("Contents")
    parts = doc.get(contents, []) if not isinstance(contents, Ref) or int(contents) not in doc.streams else [contents]
    reader = Reader(b"\n".join(doc.stream(p) for p in (parts if isinstance(parts, list) else [parts])))
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, stack, text, line = one, [], one, one
    state = {"font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
    out, operands = [], []

    def show(raw):
        nonlocal text
        font = state["font"]
        if font is None:
            return
        at = _times((1, 0, 0, 1, 0, state["rise"]), _times(text, ctm))
        chars, advance = [], 0.0
        for c, w, space in font.decode(raw):
            chars.append(c)
            advance += (w * state["size"] + state["char"] + state["word"] * space) * state["scale"]
        text = _times((1, 0, 0, 1, advance, 0), text)
        end = _times(text, ctm)
        size = state["size"] * max(abs(at[3]), abs(at[1]))
        if "".join(chars):
            out.append({"text": "".join(chars), "x": at[4], "y": at[5], "x1": max(end[4], at[4]), "size": abs(size), "font": font.name, "rise": state["rise"]})

    def next_line(x, y):
        nonlocal line, text
        line = text = _times((1, 0, 0, 1, x, y), line)

    number = lambda v: float(v) if isinstance(v, (int, float)) else 0.0
    while (v := reader.value()) is not None:
        if not isinstance(v, bytes):
            operands.append(v)
            continue
        n = [number(o) for o in operands]
        if v == b"q":
            stack.append((ctm, dict(state)))
        elif v == b"Q" and stack:
            ctm, state = stack.pop()
        elif v == b"cm" and len(n) == 6:
            ctm = _times(n, ctm)
        elif v == b"BT":
            text = line = one
        elif v == b"Tf" and len(operands) == 2:
            state["font"], state["size"] = fonts.get(str(operands[0])), n[1]
        elif v in (b"Td", b"TD") and len(n) == 2:
            if v == b"TD":
                state["lead"] = -n[1]
            next_line(*n)
        elif v == b"Tm" and len(n) == 6:
            line = text = tuple(n)
        elif v == b"T*":
            next_line(0, -state["lead"])
        elif v in (b"Tc", b"Tw", b"TL", b"Ts") and n:
            state[{b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise"}[v]] = n[0]
        elif v == b"Tz" and n:
            state["scale"] = n[0] / 100
        elif v in (b"Tj", b"'", b'"') and operands:
            if v != b"Tj":
                next_line(0, -state["lead"])
            if isinstance(operands[-1], tuple):
                show(operands[-1][1])
        elif v == b"TJ" and operands and isinstance(operands[0], list):
            for item in operands[0]:
                if isinstance(item, tuple):
                    show(item[1])
                else:
                    text = _times((1, 0, 0, 1, -number(item) / 1000 * state["size"] * state["scale"], 0), text)
        elif v == b"BI":
            end = re.compile(rb"[\x00\t\n\f\r ]EI(?=[\x00\t\n\f\r ])").search(reader.data, reader.at)
            reader.at = end.end() if end else len(reader.data)
        operands = []
    return out


def page_box(doc: Document, page: dict) -> tuple[tuple[float, float, float, float], int]:
    box = doc.get(page.get("CropBox")) or doc.get(page.get("MediaBox")) or DEFAULT_BOX
    values = [doc.get(v) for v in box]
    if len(values) != 4 or not all(isinstance(v, (int, float)) for v in values):
        values = DEFAULT_BOX
    x0, y0, x1, y1 = values
    return (min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)), int(doc.get(page.get("Rotate"), 0) or 0) % 360


def page_lines(doc: Document, page: dict) -> tuple[float, float, list[dict]]:
    """Width, height and lines of a page in display space, in drawing order."""
    box, turn = page_box(doc, page)
    raw_w, raw_h = box[2] - box[0], box[3] - box[1]
    width, height = (raw_h, raw_w) if turn in (90, 270) else (raw_w, raw_h)

    def place(x, y):
        x, y = x - box[0], y - box[1]
        return {90: (y, raw_w - x), 180: (raw_w - x, raw_h - y), 270: (raw_h - y, x)}.get(turn, (x, y))

    lines: list[dict] = []
    for run in glyph_runs(doc, page):
        if not run["text"].strip() and not lines:
            continue
        x, y = place(run["x"], run["y"])
        x1, _ = place(run["x1"], run["y"])
        size = run["size"] or 1.0
        span = {"text": run["text"], "x0": min(x, x1), "x1": max(x, x1), "base": y, "size": size, "font": run["font"]}
        last = lines[-1] if lines else None
        reach = max(size, last["size"]) if last else size
        if last and abs(y - last["base"]) <= SAME_LINE * reach and -0.5 * reach <= span["x0"] - last["x1"] <= SAME_ROW_GAP * reach:
            gap = span["x0"] - last["x1"] > WORD_GAP * reach and not last["text"].endswith(" ") and not run["text"].startswith(" ")
            start = len(last["text"]) + gap
            last["text"] += " " * gap + run["text"]
            last["x1"] = max(last["x1"], span["x1"])
            last["size"] = max(last["size"], size)
        else:
            start = 0
            last = {"text": run["text"], "x0": span["x0"], "x1": span["x1"], "base": y, "size": size, "spans": []}
            lines.append(last)
        raised = run["rise"] > 0 or (size <= SMALL * last["size"] and y - last["base"] >= RAISED * last["size"])
        last["spans"].append(span | {"start": start, "end": start + len(run["text"]), "superscript": raised})
    for ln in lines:
        ln["y0"], ln["y1"] = round(height - ln["base"] - 0.8 * ln["size"], 3), round(height - ln["base"] + 0.2 * ln["size"], 3)
    return width, height, [ln for ln in lines if ln["text"].strip()]


BOX_TYPE = pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])
SPAN_TYPE = pa.struct([("text", pa.string()), ("font", pa.string()), ("size", pa.float64()), ("superscript", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())])
LINE_TYPE = pa.struct([("line_id", pa.string()), ("source_index", pa.int32()), ("text", pa.string()), ("bbox", BOX_TYPE), ("spans", pa.list_(SPAN_TYPE))])
PAGE_TYPE = pa.struct([("page_index", pa.int32()), ("page_number", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("lines", pa.list_(LINE_TYPE))])
RULE_TYPE = pa.struct([("first", pa.int32()), ("style", pa.string()), ("prefix", pa.string()), ("start", pa.int32())])
BOX_DDL = "struct<x0:double,y0:double,x1:double,y1:double>"
LINE_DDL = f"struct<line_id:string,source_index:int,text:string,bbox:{BOX_DDL},spans:array<struct<text:string,font:string,size:double,superscript:boolean,start:int,end:int>>>"
SCHEMA = f"doc_id string, fault string, pages array<struct<page_index:int,page_number:int,width:double,height:double,lines:array<{LINE_DDL}>>>, label_rules array<struct<first:int,style:string,prefix:string,start:int>>"


def read_document(content: bytes) -> dict:
    doc = Document(content)
    pages = []
    for i, page in enumerate(doc.pages()):
        width, height, found = page_lines(doc, page)
        lines = [{"line_id": f"p{i + 1:04d}-l{k + 1:04d}", "source_index": k, "text": ln["text"], "bbox": {n: round(ln[n], 3) for n in ("x0", "y0", "x1", "y1")}, "spans": [{n: s[n] for n in ("text", "font", "size", "superscript", "start", "end")} for s in ln["spans"]]} for k, ln in enumerate(found)]
        pages.append({"page_index": i, "page_number": i + 1, "width": width, "height": height, "lines": lines})
    return {"pages": pages, "label_rules": doc.label_rules()}


def read_pdfs(files: DataFrame) -> DataFrame:
    """doc_id, fault, pages and label rules of accepted PDF files (doc_id, content); a file that cannot be read has a fault."""

    def rows(batches):
        for batch in batches:
            made, faults = [], []
            for content in batch.column("content").to_pylist():
                try:
                    made.append(read_document(content))
                    faults.append(None)
                except Exception as e:  # a broken file is a row with its fault, not a failed job
                    made.append({"pages": [], "label_rules": []})
                    faults.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(faults, pa.string()), pa.array([m["pages"] for m in made], pa.list_(PAGE_TYPE)), pa.array([m["label_rules"] for m in made], pa.list_(RULE_TYPE))], names=["doc_id", "fault", "pages", "label_rules"])

    return files.select("doc_id", "content").mapInArrow(rows, SCHEMA)


def pages(read: DataFrame) -> DataFrame:
    """doc_id, page_index, page_number, width, height, text_quality, needs_ocr (the page has no text)."""
    from lexweave.functions.text import text_quality

    rows = read.select("doc_id", F.inline("pages"))
    return rows.select("doc_id", "page_index", "page_number", "width", "height", text_quality(F.transform("lines", lambda x: x["text"])).alias("text_quality"), (F.size("lines") == 0).alias("needs_ocr"))


def lines(read: DataFrame) -> DataFrame:
    """Lines with their boxes and spans; reading order is drawing order until the layout operators change it."""
    rows = read.select("doc_id", F.inline("pages")).select("doc_id", "page_index", "page_number", F.inline("lines"))
    return rows.withColumns({"reading_order": F.col("source_index"), "region_type": F.lit("unknown"), "note_region_mode": F.lit(""), "exclude_from_body": F.lit(False)})
