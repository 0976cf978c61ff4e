"""Statute lines to provisions, footnotes, diagnostics and titles.

Documents are grouped once, by doc_id; a document's lines are read in order by a reader that keeps the open
containers and puts out flat rows. What follows the structure (citations, resolution, summaries) is done on
the flat tables, so that a very large Act is one task only while its structure is read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import patterns as P
from lexweave.operators.amendments import amendment
from lexweave.operators.citations import find_citations

_SECTION, _SUBSECTION, _CLAUSE, _SUBCLAUSE, _PROVISO, _EXPLANATION, _NOTE, _TAIL, _DIVISION, _TITLE = map(
    re.compile, (P.SECTION, P.SUBSECTION, P.CLAUSE, P.SUBCLAUSE, P.PROVISO, P.EXPLANATION, P.NOTE_LINE, P.NOTE_TAIL, P.DIVISION, P.DIVISION_TITLE)
)

PROVISION_FIELDS = "eid string, kind string, num string, heading string, text string, parent_eid string, holder int, seq int, depth int, page_numbers array<int>"
NOTE_FIELDS = "number string, raw_text string, amend_text string, page_number int, associated_eid string"
DIAGNOSTIC_FIELDS = "code string, message string"
CITATION_FIELDS = "parent_eid string, cite_seq int, raw_text string, span_start int, span_end int, target_eid string, relation string, external boolean, target_type string, resolved boolean"


def section_start(text: str) -> tuple[str, str] | None:
    """Number and remainder of a line that opens a section; a digit after the dot is a decimal or a date."""
    m = _SECTION.match(text)
    if not m or m[3][:1].isascii() and m[3][:1].isdigit():
        return None
    return m[2] or m[1], m[3].strip()


def opens_provision(text: str) -> bool:
    return bool(section_start(text) or any(p.match(text) for p in (_SUBSECTION, _CLAUSE, _PROVISO, _EXPLANATION)))


def marginal_note(rest: str) -> bool:
    """A short noun phrase that stands where a heading does."""
    return bool(rest) and len(rest.encode()) <= P.MARGINAL_NOTE_BYTES and not any(v in rest for v in P.MARGINAL_NOTE_VETOES) and not rest.lower().startswith(P.SENTENCE_OPENERS)


def split_heading(rest: str) -> tuple[str | None, str]:
    """Heading and body of what follows a section's number: at the first separator, if there is one."""
    best = None
    for rank, (mark, needs_upper) in enumerate(P.HEADING_SEPARATORS):
        at = rest.find(mark)
        while at >= 0:
            end = at + len(mark)
            after = rest[end:].lstrip()
            if not needs_upper or not after or after[0].isupper():
                best = min(best or (at, rank, end), (at, rank, end))
                break
            at = rest.find(mark, end)
    if best:
        return rest[: best[0]].strip(), rest[best[2] :].strip()
    if rest.startswith("(") or not marginal_note(rest):
        return None, rest
    return rest, ""


def clause_label(ordinal: int) -> str:
    """The label expected for a clause: a to z, then aa, ab and so on."""
    if ordinal < 26:
        return chr(97 + ordinal)
    tens, ones = divmod(ordinal - 26, 26)
    return chr(97 + tens) + chr(97 + ones)


def carries_over(previous: str) -> bool:
    """The line before ends in a word that cannot end a heading."""
    words = previous.split()
    last = re.sub(r"^[\W_]+|[\W_]+$", "", words[-1]).lower() if words else ""
    return last in P.CONNECTORS


#: A level of containers and those inside it, the innermost first.
INNERMOST_FIRST = {"section": ("clause", "subsection", "section"), "subsection": ("clause", "subsection"), "clause": ("clause",)}


class Reader:
    """Reads one document's lines. Rows hold what is printed; holders say where a row stands in the tree."""

    def __init__(self):
        self.rows: list[dict] = []
        self.notes: list[dict] = []
        self.diagnostics: list[tuple[str, str]] = []
        self.preamble: list[tuple[str, int]] = []
        self.open: dict[str, int | None] = {"section": None, "subsection": None, "clause": None}
        self.roots: list[int] = []  # roots already closed, in the order they closed
        self.roots_by_eid: dict[str, list[int]] = {}
        self.seen: dict[str, int] = {}
        self.counts: dict[tuple[str, str], int] = {}
        self.ordinal = 0
        self.chapters = self.schedules = 1
        self.in_schedule = False
        self.last_item = 0
        self.title_due = False

    # -- containers

    def warn(self, code: str, message: str) -> None:
        self.diagnostics.append((f"statute.{code}", message))

    def add(self, kind: str, eid: str, num: str, text: str, page: int, parent: str | None = None, heading: str | None = None, holder: int | None = None) -> int:
        self.rows.append({"eid": eid, "kind": kind, "num": num, "heading": heading, "text": text, "parent_eid": parent, "holder": holder, "pages": [page]})
        return len(self.rows) - 1

    def unique(self, kind: str, page: int, base: str) -> str:
        """The base, or the base with its count where it has been given before."""
        n = self.seen[base] = self.seen.get(base, 0) + 1
        if n == 1:
            return base
        self.warn("duplicate_provision_eid", f"the eId {base} of a {kind} on page {page} is taken already, {n - 1} time(s)")
        return f"{base}__dup{n}"

    def inner(self, *levels: str) -> int | None:
        return next((self.open[x] for x in levels if self.open[x] is not None), None)

    def eid_of(self, row: int | None) -> str:
        return "sec_unknown" if row is None else self.rows[row]["eid"]

    def add_root(self, row: int) -> None:
        self.roots.append(row)
        self.roots_by_eid.setdefault(self.rows[row]["eid"], []).append(row)

    def rooted(self, row: int) -> None:
        """A row without an open container becomes a root; its eId still says that none was open."""
        self.rows[row]["parent_eid"] = None
        self.add_root(row)

    def close(self, level: str) -> None:
        """Closes the open container of a level with all that is open inside it."""
        for inside in INNERMOST_FIRST[level]:
            row = self.open[inside]
            if row is None:
                continue
            self.open[inside] = None
            if inside == "section":
                self.close_section(row)
            else:
                holder = self.inner(*("subsection", "section")[0 if inside == "clause" else 1 :])
                self.rows[row]["holder"] = holder
                if holder is None:
                    self.rooted(row)

    def close_section(self, row: int) -> None:
        if self.rows[row]["kind"] == "schedule_item":
            schedules = self.roots_by_eid.get(self.rows[row]["parent_eid"])
            if schedules:
                self.rows[row]["holder"] = schedules[0]
                return
        self.add_root(row)

    def attach(self, row: int, *levels: str) -> None:
        holder = self.inner(*levels)
        self.rows[row]["holder"] = holder
        if holder is None:
            self.rooted(row)

    def extend(self, row: int, text: str, page: int) -> None:
        node = self.rows[row]
        node["text"] = f"{node['text']} {text}" if node["text"] else text
        if page not in node["pages"]:
            node["pages"].append(page)

    def proceed(self, text: str, page: int) -> None:
        """A line that opens nothing belongs to the innermost open container."""
        row = self.inner("clause", "subsection", "section")
        if row is not None:
            self.extend(row, text, page)
        elif not self.roots:
            self.preamble.append((text, page))
        elif self.rows[self.roots[-1]]["kind"] == "chapter":
            self.extend(self.roots[-1], text, page)
        else:
            self.warn("orphan_line", f"no open provision takes this line: {text}")

    # -- openers, in order of precedence; each says whether it took the line

    def section(self, text: str, page: int, before: str | None) -> bool:
        start = section_start(text)
        if not start:
            return False
        number, rest = start
        digits = int(number) if number.isdigit() else None
        if self.in_schedule and digits is not None and digits <= self.last_item + 1:
            parent = f"schedule_{self.schedules - 1}"
            eid = self.unique("schedule_item", page, f"{parent}__item_{number.lower()}")
            self.close("section")
            self.open["section"] = self.add("schedule_item", eid, number, rest, page, parent)
            self.last_item, self.ordinal = digits, 0
            return True
        self.in_schedule = False
        eid = f"sec_{number.lower()}"
        held = list(self.roots_by_eid.get(eid, ()))
        current = self.open["section"]
        if current is not None and self.rows[current]["eid"] == eid:
            held.append(current)
        stub = next((r for r in held if self.is_stub(r)), None)
        if stub is not None and stub != current:
            self.roots.remove(stub)
            self.roots_by_eid[eid].remove(stub)
            self.warn("empty_section_stub_replaced", f"the empty section {number} found before gives way to this one")
        elif stub is None and held:
            self.warn("duplicate_section_number", f"section {number} occurs again, and its line is read as text")
            self.proceed(text, page)
            return True
        self.close("section")
        self.ordinal, self.title_due = 0, False
        heading, body = split_heading(rest)
        first = _SUBSECTION.match(body)
        row = self.open["section"] = self.add("section", eid, number, "" if first else body, page, heading=heading)
        if first:
            base = f"{eid}__subsec_{first[1].lower()}"
            self.open["subsection"] = self.add("subsection", self.unique("subsection", page, base), f"({first[1]})", first[2].strip(), page, self.rows[row]["eid"])
        return True

    def is_stub(self, row: int) -> bool:
        return not self.rows[row]["text"].strip() and not any(r["holder"] == row for r in self.rows)

    def subsection(self, text: str, page: int, before: str | None) -> bool:
        m = _SUBSECTION.match(text)
        if not m:
            return False
        self.close("subsection")
        self.ordinal = 0
        parent = self.eid_of(self.open["section"])
        eid = self.unique("subsection", page, f"{parent}__subsec_{m[1].lower()}")
        self.open["subsection"] = self.add("subsection", eid, f"({m[1]})", m[2].strip(), page, parent)
        return True

    def bracketed(self, text: str, page: int, before: str | None) -> bool:
        """A line in brackets: a sub-clause, a clause, or prose."""
        if not text.startswith("(") or ")" not in text:
            return False
        token = text[1 : text.index(")")]
        roman = bool(re.fullmatch("[ivx]+", token))
        if roman and (len(token) >= 3 or (self.open["clause"] is not None and token != clause_label(self.ordinal))):
            m = _SUBCLAUSE.match(text)
            parent = self.eid_of(self.inner("clause", "subsection", "section"))
            row = self.add("subclause", self.unique("subclause", page, f"{parent}__subcl_{m[1]}"), f"({m[1]})", m[2].strip(), page, parent)
            self.attach(row, "clause", "subsection", "section")
        elif m := _CLAUSE.match(text):
            self.close("clause")
            parent = self.eid_of(self.inner("subsection", "section"))
            eid = self.unique("clause", page, f"{parent}__cl_{m[1].lower()}")
            self.open["clause"] = self.add("clause", eid, f"({m[1]})", m[2].strip(), page, parent)
            self.ordinal += m[1].islower()
        else:
            self.proceed(text, page)
        return True

    def proviso(self, text: str, page: int, before: str | None) -> bool:
        m = _PROVISO.match(text)
        if not m:
            return False
        self.close("clause")
        parent = self.eid_of(self.inner("subsection", "section"))
        n = self.counts["proviso", parent] = self.counts.get(("proviso", parent), 0) + 1
        self.attach(self.add("proviso", f"{parent}__proviso_{n}", m[1].strip(), m[2].strip(), page, parent), "subsection", "section")
        return True

    def explanation(self, text: str, page: int, before: str | None) -> bool:
        m = _EXPLANATION.match(text)
        if not m:
            return False
        parent = self.eid_of(self.inner("clause", "subsection", "section"))
        self.close("clause")
        suffix = m[1]
        if suffix is None:
            n = self.counts["explanation", parent] = self.counts.get(("explanation", parent), 0) + 1
            suffix = str(n) if n > 1 else ""
        eid = f"{parent}__expl" + (f"_{suffix}" if suffix else "")
        self.attach(self.add("explanation", eid, f"Explanation {m[1]}" if m[1] else "Explanation", m[2].strip(), page, parent), "subsection", "section")
        return True

    def division(self, text: str, page: int, before: str | None) -> bool:
        if not _DIVISION.match(text) or text.rstrip().endswith((".", ";", ",", ":")) or (before is not None and carries_over(before)):
            return False
        self.close("section")
        words = text.split(maxsplit=1) if not text[:1].isspace() else ["", text.strip()]
        number = words[1].strip() if len(words) > 1 and words[1].strip() else text.strip()
        upper = text.lstrip().upper()
        rest = next((upper[len(w) :].strip() for w in ("SCHEDULES", "SCHEDULE") if upper.startswith(w)), "")
        if rest:
            self.add_root(self.add("schedule", f"schedule_{self.schedules}", number, "", page))
            self.schedules += 1
            self.in_schedule, self.last_item = True, 0
        else:
            self.in_schedule = False
            self.add_root(self.add("chapter", f"chapter_{self.chapters}", number, "", page))
            self.chapters += 1
            self.title_due = True
        return True

    def division_title(self, text: str, page: int, before: str | None) -> bool:
        if not self.title_due:
            return False
        self.title_due = False
        if not self.roots or section_start(text) or not _TITLE.match(text):
            return False
        node = self.rows[self.roots[-1]]
        node["heading"] = text
        if page not in node["pages"]:
            node["pages"].append(page)
        return True

    # -- passes over the lines

    def split_notes(self, lines: list[tuple[str, int, str]]) -> list[tuple[str, int]]:
        """Takes the footnotes out; gives the body lines."""
        body: list[tuple[str, int]] = []
        note: dict | None = None

        def finish():
            nonlocal note
            if note:
                raw = " ".join(note["lines"])
                self.notes.append({"number": note["number"], "raw": raw, "amend": raw, "page": note["page"]})
            note = None

        for text, page, kind in lines:
            label, tail = _NOTE.match(text), bool(_TAIL.match(text))
            if (label or note is None) if kind == "note" else label:
                finish()
                note = {"number": label[1] if label else re.match("[0-9]*", text)[0], "lines": [text], "page": page}
                continue
            if note:
                heading = section_start(text) is None and _DIVISION.match(text)
                if not heading and (kind == "note" or tail or not (kind == "body" or opens_provision(text))):
                    note["lines"].append(text)
                    continue
                finish()
            if tail:
                if self.notes and self.notes[-1]["page"] == page:
                    self.notes[-1]["raw"] += f" {text}"
                    continue
                self.warn("note_tail_unattached", f"the end of a note without its beginning: {text}")
            body.append((text, page))
        finish()
        return body

    def read(self, lines: list[tuple[str, int, str]]) -> None:
        before = None
        openers = (self.section, self.subsection, self.bracketed, self.proviso, self.explanation, self.division, self.division_title)
        for text, page in self.split_notes(lines):
            if not any(take(text, page, before) for take in openers):
                self.proceed(text, page)
            before = text
        self.close("section")
        if self.preamble:
            self.warn("preamble_recovered", f"front matter of {len(self.preamble)} line(s) stands before the first provision")
            row = self.add("chapter", "act_preamble", "PREAMBLE", " ".join(t for t, _ in self.preamble), 0)
            self.rows[row]["pages"] = sorted({p for _, p in self.preamble})
            self.roots.insert(0, row)

    def tree_order(self) -> list[tuple[int, int]]:
        """Rows with their depth, parents before children."""
        below: dict[int, list[int]] = {}
        for i, r in enumerate(self.rows):
            if r["holder"] is not None:
                below.setdefault(r["holder"], []).append(i)
        out, stack = [], [(r, 0) for r in reversed(self.roots)]
        while stack:
            row, depth = stack.pop()
            out.append((row, depth))
            stack += [(c, depth + 1) for c in reversed(below.get(row, []))]
        return out

    def hosts(self, order: list[tuple[int, int]]) -> list[str | None]:
        """For each note the first row in tree order with its marker: [n] set against a word, or n[."""
        first: dict[str, str] = {}
        wanted = {n["number"] for n in self.notes}
        for row, _ in order if wanted else ():
            text = self.rows[row]["text"]
            found = {m[1] for m in re.finditer(r"(?<![0-9\s])\[([0-9]+)\](?![0-9\s])", text)} | {m[1] for m in re.finditer(r"(?<![0-9])([0-9]+)\[(?![0-9])", text)}
            if "" in wanted and re.search(r"(?<![0-9])\[(?![0-9])", text):
                found.add("")
            for number in found & wanted:
                first.setdefault(number, self.rows[row]["eid"])
        return [first.get(n["number"]) for n in self.notes]


def read_document(lines: list[tuple[str, int, str]]) -> dict:
    """Provisions (in tree order), notes and diagnostics of one document's (text, page, note class) lines."""
    reader = Reader()
    reader.read(lines)
    order = reader.tree_order()
    place = {row: k for k, (row, _) in enumerate(order)}
    provisions = []
    for seq, (row, depth) in enumerate(order):
        r = reader.rows[row]
        provisions.append({"eid": r["eid"], "kind": r["kind"], "num": r["num"], "heading": r["heading"], "text": r["text"], "parent_eid": r["parent_eid"], "holder": place.get(r["holder"]) if r["holder"] is not None else None, "seq": seq, "depth": depth, "page_numbers": r["pages"]})
    notes = [{"number": n["number"], "raw_text": n["raw"], "amend_text": n["amend"], "page_number": n["page"], "associated_eid": h} for n, h in zip(reader.notes, reader.hosts(order))]
    return {"provisions": provisions, "notes": notes, "diagnostics": [{"code": c, "message": m} for c, m in reader.diagnostics]}


def cite_document(provisions_: list[dict]) -> list[dict]:
    """Citations of one document's provisions, resolved against its own eIds."""
    known = {p["eid"] for p in provisions_}
    out = []
    for p in provisions_:
        for n, c in enumerate(find_citations(p["text"])):
            out.append(c | {"parent_eid": p["eid"], "cite_seq": n, "resolved": not c["external"] and c["target_eid"] in known})
    return out


def _array_type(fields: str) -> str:
    return f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"


def parse(lines: DataFrame, doc: str = "doc_id", cite: bool = False, parts: tuple[str, ...] = ("provisions", "notes", "diagnostics")) -> DataFrame:
    """One row for each document: provisions, notes and diagnostics as arrays. Lines need doc_id, seq, text, page_number, note_class.

    cite: also the resolved citations, found in the same pass; without it they can be found on the flat
    provisions, in parallel inside a document, at the price of a join for their resolution. parts: the arrays that
    leave the worker.
    """
    kind = lines.schema[doc].dataType.simpleString()
    numbered = lines.select(F.col(doc).alias("doc_id"), F.struct("seq").alias("seq"), "text", F.col("page_number").cast("int").alias("page_number"), "note_class")
    grouped = numbered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text", "page_number", "note_class"))).alias("lines"))
    plain = grouped.select("doc_id", F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["page_number"].alias("page_number"), x["note_class"].alias("note_class"))).alias("lines"))
    every = {"provisions": PROVISION_FIELDS, "notes": NOTE_FIELDS, "diagnostics": DIAGNOSTIC_FIELDS}
    fields_of = {name: every[name] for name in parts} | ({"citations": CITATION_FIELDS} if cite else {})
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    arrow = {name: pa.list_(pa.struct([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])) for name, fields in fields_of.items()}

    def rows(batches):
        for batch in batches:
            made = [read_document([(x["text"], x["page_number"], x["note_class"]) for x in doc_lines]) for doc_lines in batch.column("lines").to_pylist()]
            if cite:
                made = [m | {"citations": cite_document(m["provisions"])} for m in made]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([m[n] for m in made], t) for n, t in arrow.items())], names=["doc_id", *arrow])

    return plain.mapInArrow(rows, f"doc_id {kind}, " + ", ".join(f"{name} {_array_type(fields)}" for name, fields in fields_of.items()))


def citations(parsed: DataFrame) -> DataFrame:
    """Citations of documents parsed with cite."""
    return parsed.select("doc_id", F.inline("citations"))


def provisions(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("provisions"))


def diagnostics(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.posexplode("diagnostics").alias("seq", "d")).select("doc_id", "seq", F.lit("warning").alias("severity"), "d.code", "d.message")


def footnotes(parsed: DataFrame) -> DataFrame:
    """doc_id, seq, number, raw_text, page_number, associated_eid, amendment."""
    rows = parsed.select("doc_id", F.posexplode("notes").alias("seq", "n")).select("doc_id", "seq", "n.*")
    return rows.select("doc_id", "seq", "number", "raw_text", "page_number", "associated_eid", amendment(F.col("amend_text")).alias("amendment"))


def attached_amendments(notes: DataFrame) -> DataFrame:
    """doc_id, eid and amendment: of the notes that a provision hosts the first, if that one amends."""
    hosted = notes.where("associated_eid is not null")
    first = hosted.groupBy("doc_id", F.col("associated_eid").alias("eid")).agg(F.min_by(F.struct("amendment"), "seq").alias("first"))
    return first.select("doc_id", "eid", F.col("first.amendment").alias("amendment")).where("amendment is not null")


def _title_case(name: Column) -> Column:
    words = F.split(name, " ")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*P.LOWER_TITLE_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))))
    return F.array_join(cased, " ")


def metadata(parsed: DataFrame, title: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, title, act_number, act_year: from the long title, else from the caller, else a neutral one. keep: columns that stay."""
    front = F.get(F.filter("provisions", lambda p: p["eid"] == "act_preamble"), F.lit(0))["text"]
    rows = parsed.select("doc_id", front.alias("front"), (title if title is not None else F.lit(None).cast("string")).alias("given"), *keep)
    named = F.col("front").rlike(P.LONG_TITLE)
    long = F.concat(F.lit("The "), _title_case(F.regexp_extract("front", P.LONG_TITLE, 1)), F.lit(" Act, "), F.regexp_extract("front", P.LONG_TITLE, 2))
    number = F.concat(F.lit("Act "), F.regexp_extract("front", P.ACT_NUMBER, 1), F.lit(" of "), F.regexp_extract("front", P.ACT_NUMBER, 2))
    return rows.select(
        "doc_id",
        F.coalesce(F.when(named, long), "given", F.lit(P.FALLBACK_TITLE)).alias("title"),
        F.when(F.col("front").rlike(P.ACT_NUMBER), number).alias("act_number"),
        F.when(named, F.regexp_extract("front", P.LONG_TITLE, 2)).alias("act_year"),
        *keep,
    )

