import gzip
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.sources import docx, files
from lexweave.streaming import batches

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCUMENT = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>It’s here</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:footnoteReference w:id="5"/></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>next</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
NOTES = f'<w:footnotes {W}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote><w:footnote w:id="5"><w:p><w:r><w:t>See supra note 3</w:t></w:r></w:p></w:footnote></w:footnotes>'


def test_word_documents(spark):
    good = package({"word/document.xml": DOCUMENT, "word/footnotes.xml": NOTES})
    units = docx.text_units(good)
    assert [(u["kind"], u["number"], u["text"], u["references"]) for u in units] == [("body", 1, "Title", []), ("body", 2, "It's here", [1]), ("body", 3, "cell", []), ("body", 4, "next", []), ("footnote", 1, "See supra note 3", [1])]
    cells = [p["cell"] for p in docx.body_paragraphs(DOCUMENT.encode())]
    assert cells[2] == {"row": 0, "column": 0, "columns": 2, "continues": False} and cells[3]["column"] == 2
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"not a zip")), ("c", bytearray(package({"../x": "y"})))], "path string, content binary")
    faults = {r.path: r.fault for r in docx.read_units(df).select("path", "fault").distinct().collect()}
    assert faults["a"] is None and faults["b"] and faults["c"] == "unsafe part name"
    assert docx.numbered_supra("supra, at note 12") and not docx.numbered_supra("supra")
    assert docx.read_parts(docx.write_parts({"a/b": b"1"})) == {"a/b": b"1"}


def test_pdf_files_and_manifests(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"junk%PDF-1.7 body")
    (tmp_path / "b.pdf").write_bytes(b"no signature")
    (tmp_path / "c.pdf").write_bytes(b"")
    found = files.read_binary(spark, str(tmp_path))
    assert found.count() == 2
    good = files.accepted(found).collect()
    sha = hashlib.sha256(b"junk%PDF-1.7 body").hexdigest()
    assert [(r.source_sha256, r.doc_id) for r in good] == [(sha, f"doc-{sha[:20]}")]
    manifest = spark.createDataFrame([("a.pdf", sha, 1), ("b.pdf", sha, 1), ("z.pdf", sha, 1), ("../a.pdf", sha, 1)], "path string, sha256 string, pages int")
    named = found.withColumn("relative_path", F.element_at(F.split("path", "/"), -1))
    assert {r.path: r.state for r in files.verified(manifest, named).collect()} == {"a.pdf": "ok", "b.pdf": "changed", "z.pdf": "missing", "../a.pdf": "bad_path"}


def test_json_round_trip(spark, tmp_path):
    with gzip.open(tmp_path / "one.json.gz", "wt") as f:
        json.dump({"a": 1}, f)
    assert files.read_json(spark, str(tmp_path / "one.json.gz"), "a int").first().a == 1
    files.write_json(spark.range(3), str(tmp_path / "out"))
    assert files.read_json(spark, str(tmp_path / "out"), "id long", lines=True).count() == 3
    row = spark.range(1).select(files.spaced_json(F.struct(F.lit("a,b").alias("x"), F.lit(1).alias("y"))).alias("j")).first()
    assert row.j == '{"x": "a,b", "y": 1}'


def test_supplied_ocr(spark):
    line = lambda b, c=0.5: {"text": "ab", "bbox": b, "confidence": c, "words": [{"text": "ab", "bbox": b, "start": 0, "end": 2}]}
    page = lambda i, *ls: {"page_index": i, "width": 100.0, "height": 100.0, "lines": list(ls)}
    ok = [0.0, 0.0, 10.0, 10.0]
    docs = [("good", "h", [page(0, line(ok))]), ("source", "x", []), ("line", "h", [page(0, line([0.0, 0.0, 200.0, 10.0]))]), ("sure", "h", [page(0, line(ok, 2.0))]), ("twice", "h", [page(0), page(0)])]
    df = spark.createDataFrame(docs, f"doc_id string, {files.OCR_SCHEMA}")
    assert {r.doc_id: r.fault for r in files.supplied_ocr_faults(df, F.lit("h")).collect()} == {"good": None, "source": "source", "line": "line", "sure": "line", "twice": "repeated_page"}
    asked = spark.createDataFrame([("good", 0, 100.2, 100.0), ("good", 1, 1.0, 1.0), ("line", 0, 90.0, 100.0)], "doc_id string, page_index int, width double, height double")
    assert {(r.doc_id, r.page_index): r.fault for r in files.supplied_lines(df, asked).collect()} == {("good", 0): None, ("good", 1): "missing", ("line", 0): "size"}


def test_ocr_tables(spark):
    rows = [("5", "1", "1", "1", "1", "2", "30", "5", "10", "10", "90", "world"), ("5", "1", "1", "1", "1", "1", "10", "6", "15", "10", "-1", "hello"), ("4", "1", "1", "1", "1", "0", "0", "0", "9", "9", "5", "x"), ("5", "1", "1", "1", "2", "1", "bad", "0", "9", "9", "5", "y")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in files.TSV_FIELDS))
    got = files.ocr_lines(df, x_scale=2.0, page_width=70.0).collect()
    assert [(r.text, r.bbox.x0, r.bbox.x1, r.confidence, r.n_words) for r in got] == [("hello world", 20.0, 70.0, 0.9, 2)]


def test_page_labels(spark):
    pages = spark.createDataFrame([(d, i) for d in (1, 2) for i in range(30)], "doc_id int, page_index int")
    rules = spark.createDataFrame([(1, 0, "r", None, None), (1, 2, "A", "App-", 1), (2, 0, "D", "", 1), (2, 9, "Q", "", 1)], "doc_id int, first int, style string, prefix string, start int")
    got = {(r.doc_id, r.page_index): r.label for r in files.page_labels(pages, rules).collect()}
    assert (got[1, 0], got[1, 1], got[1, 2], got[1, 28]) == ("i", "ii", "App-A", "App-AA") and got[2, 0] is None


def test_a_stream_of_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"doc_id": 1, "text": "1. One.—See section 2\n2. Two.—x"}) + "\n")
    query = batches.parse_stream(batches.text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out" / "citations"))
    assert [(r.target_eid, r.resolved) for r in found.collect()] == [("sec_2", True)]


@pytest.mark.parametrize("n, text", [(1, "I"), (4, "IV"), (1999, "MCMXCIX")])
def test_roman_numerals(spark, n, text):
    assert spark.range(1).select(files.roman_numeral(F.lit(n)).alias("r")).first().r == text
