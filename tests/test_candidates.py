import json

from pyspark.sql import functions as F

from lexweave.functions import shapes
from lexweave.operators import candidates
from test_pdf import build, page

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def rows(spark, *items):
    made = [(1, p, k, f"l{k}", t, r) for k, (p, t, r) in enumerate(items)]
    return spark.createDataFrame(made, "doc_id int, page_index int, reading_order int, line_id string, text string, region_type string")


def test_reference_forms():
    found = lambda t, **k: [(c[2], c[3]) for c in candidates.reference_candidates(t, **k)]
    assert found("the court held.12 Then it") == [(12, "tight")]
    assert found("as decided² and so") == [(2, "superscript")] and found("as decided 2", superscripts=[(11, 12)]) == [(2, "superscript")]
    assert found("see s. 12 and 5 years, on May 3, or 3 June") == []
    assert found("it held (4) so") == [(4, "paren")] and found("It ended. 7") == [(7, "spaced_eol")]
    assert found("held12", protected=[(0, 6)]) == [] and found(None) == []


def test_labels_styles_and_bodies(spark):
    df = rows(spark, (0, "1 First note exam-", "footnote"), (0, "ple goes on", "footnote"), (1, "and on.", "footnote"), (1, "2 Second", "footnote"), (1, "body", "body"), (1, "(3) third", "footnote"))
    labels = candidates.label_rows(df.where("region_type = 'footnote'"))
    assert sorted((r.label, r.form) for r in labels.collect()) == [("1", "plain"), ("2", "plain"), ("3", "paren")]
    assert not candidates.label_style(labels).first().in_brackets
    bodies = {r.label: (r.body, r.body_pages) for r in candidates.note_bodies(df, labels).collect()}
    assert bodies["1"] == ("1 First note example goes on and on.", [0, 1]) and bodies["2"][0] == "2 Second"


def test_detached_marks_find_their_pair(spark):
    pairs = spark.createDataFrame([(1, "a", "4", 1, 50, False), (1, "b", "4", 2, 90, False), (1, "c", "4", 9, 400, True)], "doc_id int, pair_id string, note_id string, page_index int, place int, endnote boolean")
    marks = spark.createDataFrame([(1, "m", "4", 2, 70), (1, "n", "4", 6, 200), (1, "o", "5", 1, 10)], "doc_id int, mark_id string, note_id string, page_index int, place int")
    assert {r.mark_id: r.pair_id for r in candidates.merge_detached(pairs, marks).collect()} == {"m": "b", "n": "c"}


def test_flow_and_headings(spark):
    df = rows(spark, (0, "This is an exam-", "body"), (0, "ple of text", "body"), (0, "going on.", "body"), (0, "New one (open", "body"), (0, "3) now", "body"), (0, "IV.", "body"), (0, "General Part", "body"), (0, "2. the rule says so, and", "body"))
    got = {r.line_id: (r.continues, r.goes_on) for r in candidates.flow_edges(df).collect()}
    assert got["l0"] == (False, True) and got["l1"] == (True, True) and got["l2"] == (True, False) and got["l4"] == (False, False)
    heads = {r.line_id: (r.value, r.title, r.plausible) for r in candidates.heading_candidates(df).collect()}
    assert heads["l5"] == ("IV", "General Part", True) and heads["l7"][2] is False


def test_contents_lists(spark):
    entries = [(0, f"Part {k} ..... {k}", "body") for k in range(3)]
    df = rows(spark, (0, "Contents", "body"), *entries, (0, "a wrapped title", "body"), *entries, (0, "prose", "body"), *[(0, "more prose", "body")] * 8)
    assert {r.line_id for r in candidates.contents_rows(df).collect()} == {f"l{k}" for k in range(8)}
    assert candidates.contents_rows(rows(spark, (0, "Contents", "body"), *entries)).count() == 0


def test_sandwich_and_top_notes(spark):
    labels = [("a", "footnote", 500.0), ("b", "footnote", 550.0), ("c", "text", 600.0), ("d", "image", 620.0), ("e", "footnote", 650.0), ("f", "text", 700.0), ("t", "footnote", 50.0)]
    df = spark.createDataFrame([(1, 0, i, n, (10.0, y, 100.0, y + 10), 600.0, 800.0) for i, n, y in labels], f"doc_id int, page_index int, region_id string, label string, bbox {BOX}, page_width double, page_height double")
    got = {r.region_id: r.label for r in candidates.sandwiched(df).collect()}
    assert got == {"a": "footnote", "b": "footnote", "c": "footnote", "d": "image", "e": "footnote", "f": "text", "t": "text"}


def test_interleaved_columns_are_repaired(spark):
    made = []
    for i in range(6):
        for side, x in (("L", 0.0), ("R", 320.0)):
            made.append((1, 0, f"{side}{i}", len(made), "some words here", (x, 100.0 + 20 * i, x + 280, 110.0 + 20 * i), "body"))
    df = spark.createDataFrame(made, f"doc_id int, page_index int, line_id string, reading_order int, text string, bbox {BOX}, region_type string")
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id int, page_index int, width double, height double")
    r = candidates.order_decisions(df, pages).first()
    assert (r.kind, r.switches, r.new_switches, r.repair) == ("two_column", 11, 1, True)


def test_zones_and_shapes(spark):
    df = spark.createDataFrame([("Footnote", "12"), ("page_number", "- 3 -"), ("Header", "x"), ("table", "x"), ("section_title", "GENERAL PART 1"), ("para", "the word is here.")], "region_type string, text string")
    got = [tuple(r) for r in df.select(shapes.zone(F.col("region_type")).alias("z"), shapes.edge_folio(F.col("region_type"), F.col("text")).alias("f"), shapes.heading_shaped(F.col("text")).alias("h"), shapes.prose_like(F.col("text")).alias("p")).collect()]
    assert got == [("note", False, False, False), ("number", True, False, False), ("header", False, False, False), ("visual", False, False, False), ("title", False, True, False), ("body", False, False, True)]


def test_citations_are_protected():
    assert candidates.protected_spans("See R v Oakes, [1986] 1 SCR 103 at 5", ("SCR", "FC")) == [(15, 31)]


def test_command_line(spark, tmp_path):
    from lexweave import cli

    (tmp_path / "a.pdf").write_bytes(build([page(1, "1. Title.-This Act.", "2. Levy.-Tax is due.")]))
    assert cli.main([str(tmp_path / "a.pdf"), "--profile", "indian-statute", "-o", str(tmp_path / "out.json")]) == 0
    act = json.loads((tmp_path / "out.json").read_text())["akomaNtoso"]["act"]
    assert "sec_1" in [s["eid"] for s in act["body"]]
