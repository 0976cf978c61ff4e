import zlib

from lexweave.operators import candidates, citations, classify, lines, marks, regions, statute
from lexweave.sources import files, pdf


def build(streams, compress=False, labels=b"", extra=b""):
    """A small file: one page for each content stream, Helvetica, 612 by 792."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R " + labels + b">>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    kids = []
    for k, s in enumerate(streams):
        body = zlib.compress(s) if compress else s
        objects[10 + 2 * k] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if compress else b"", body)
        objects[11 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (10 + 2 * k)
        kids.append(b"%d 0 R" % (11 + 2 * k))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(kids), b" ".join(kids))
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return out + b"trailer << /Root 1 0 R " + extra + b">>\n%%EOF"


def page(number, *texts):
    body = b"".join(b"1 0 0 1 72 %d Tm (%s) Tj " % (700 - 20 * i, t.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)")) for i, t in enumerate(texts))
    return b"BT /F1 12 Tf 1 0 0 1 250 760 Tm (THE LEVY ACT) Tj " + body + b"1 0 0 1 300 40 Tm (%d) Tj ET" % number


def test_text_places_and_labels():
    doc = pdf.read_document(build([b"BT /F1 10 Tf 72 700 Td [(Hel) -20 (lo) -600 (World)] TJ 5 Ts /F1 6 Tf (1) Tj ET", b"0 0 m 9 9 l S"], compress=True, labels=b"/PageLabels << /Nums [0 << /S /r >> 1 << /P (A-) /S /D /St 4 >>] >> "))
    line = doc["pages"][0]["lines"][0]
    assert line["text"] == "Hello World1" and line["bbox"]["x0"] == 72.0 and line["bbox"]["y0"] == 84.0
    assert [s["superscript"] for s in line["spans"]] == [False, False, False, True]
    assert doc["pages"][1]["lines"] == [] and doc["pages"][0]["width"] == 612.0
    assert doc["label_rules"] == [{"first": 0, "style": "r", "prefix": "", "start": 1}, {"first": 1, "style": "D", "prefix": "A-", "start": 4}]


def test_strings_names_and_object_streams():
    reader = pdf.Reader(rb"<< /A#42 (a\(b\)\101\n) /C [1 -2.5 <4a4B>] /D 7 0 R >> BT")
    assert reader.value() == {"AB": ("s", b"a(b)A\n"), "C": [1, -2.5, ("s", b"JK")], "D": 7}
    assert reader.value() == b"BT"
    packed = b"5 0 6 9 << /X 1>> [1 2 3]"
    data = b"%PDF-1.5\n9 0 obj << /Type /ObjStm /N 2 /First 8 /Length " + b"%d" % len(packed) + b" >> stream\n" + packed + b"\nendstream endobj"
    assert pdf.Document(data).objects[5] == {"X": 1}


def test_files_become_statutes(spark, tmp_path):
    texts = ["1. Short title.-This Act may be called the Act.", "2. Levy.-(1) Subject to section 1, tax shall be levied.", "3. Rates.-Notwithstanding anything in sub-section (1) of section 2, none.", "4. Rules.-As in rule 3(2)."]
    (tmp_path / "a.pdf").write_bytes(build([page(i + 1, t) for i, t in enumerate(texts)] + [b"0 0 m S"], compress=True))
    (tmp_path / "b.pdf").write_bytes(build([b""], extra=b"/Encrypt 99 0 R "))
    read = pdf.read_pdfs(files.accepted(files.read_binary(spark, str(tmp_path)))).cache()
    assert sorted(r.fault or "" for r in read.collect()) == ["", "Refused: encrypted"]
    pages = pdf.pages(read)
    assert [r.page_index for r in pages.where("needs_ocr").collect()] == [4]
    stream = lines.statute_lines(pdf.lines(read), pages)
    assert stream.where("text = 'THE LEVY ACT'").count() == 0  # the running head repeats at the edge
    provisions = statute.provisions(statute.parse(stream))
    found = citations.resolve(citations.extract_citations(provisions), provisions)
    assert {(r.target_eid, r.relation, r.resolved) for r in found.collect()} == {("sec_1", "subject_to", True), ("sec_2__subsec_1", "notwithstanding", True), ("rule_3__subrule_2", "reference", False)}


def noted(number, body, notes, small=8):
    lines_ = b"".join(b"/F1 12 Tf 1 0 0 1 72 %d Tm (%s) Tj " % (640 - 14 * i, t) for i, t in enumerate(body))
    foot = b"".join(b"/F1 %d Tf 1 0 0 1 72 %d Tm (%s) Tj " % (small, 110 - 10 * i, t) for i, t in enumerate(notes))
    return b"BT /F1 12 Tf 1 0 0 1 250 760 Tm (THE LEVY ACT) Tj /F1 12 Tf 1 0 0 1 72 670 Tm (GENERAL PART) Tj " + lines_ + foot + b"/F1 10 Tf 1 0 0 1 300 40 Tm (%d) Tj ET" % number


def test_lines_of_a_file_become_paragraphs_and_notes(spark, tmp_path):
    body = [b"The levy is due on every item that is", b"sold, and the rate is that of the table of", b"rates in force on the day of the sale."]
    streams = [noted(k + 1, body, [b"%d See the Act of %d." % (k + 1, 1990 + k), b"It is in force."] if k != 2 else [b"and so the note goes on here."]) for k in range(4)]
    (tmp_path / "a.pdf").write_bytes(build(streams, compress=True))
    read = pdf.read_pdfs(files.accepted(files.read_binary(spark, str(tmp_path)))).cache()
    found = classify.classify(pdf.lines(read), pdf.pages(read)).cache()
    kinds = {(r.page_index, r.text): r.region_type for r in found.collect()}
    assert {kinds[k, "THE LEVY ACT"] for k in range(4)} == {"header"} and {kinds[k, str(k + 1)] for k in range(4)} == {"footer"}
    assert {kinds[k, "GENERAL PART"] for k in range(4)} == {"heading"} and {kinds[k, t.decode()] for k in range(4) for t in body} == {"body"}
    assert {kinds[k, "It is in force."] for k in (0, 1, 3)} == {"footnote"} and kinds[2, "and so the note goes on here."] == "footnote"
    told = [(r.region_type, r.text) for r in regions.paragraphs(found).orderBy("ordinal").collect()]
    assert told[:2] == [("heading", "GENERAL PART"), ("body", " ".join(t.decode() for t in body))] and len(told) == 8
    notes = {r.label: r.body for r in candidates.note_bodies(found, candidates.label_rows(found.where("region_type = 'footnote'"))).collect()}
    assert notes["1"] == "1 See the Act of 1990. It is in force." and notes["2"].endswith("and so the note goes on here.")
    assert {r.page_index for r in marks.note_modes(found).collect()} == {0, 1, 2, 3}
    assert classify.classify(pdf.lines(read).limit(0), pdf.pages(read)).count() == 0
