import json

import pytest
from pyspark.sql import functions as F

from lexweave.functions import geometry, shapes, stats
from lexweave.functions import text as T
from lexweave.operators import corpus, export, furniture, ladder, layout, lines, lookup, notes, regions, statute

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def one(spark, column, **values):
    return spark.range(1).select(*[v.alias(k) if not isinstance(v, (int, float, str)) else F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("r")).first().r


def test_heading_ladder_takes_the_shortest_jump():
    out, status = ladder.read_ladder([("I", "."), ("A", "."), ("C", "."), ("II", ".")])
    assert [(a[1], a[2], a[3]) for a in out] == [(1, "open_level", 1), (1, "open_level", 2), (3, "jump_forward", 2), (2, "increment", 1)]
    assert status == "parsed_clean"
    assert ladder.read_ladder([]) == ([], "no_enumerators")
    assert ladder.readings("3.2.14", ".") == [("legal_numeric_.", 14)] and ladder.readings("c", ")") == [("lower_alpha_)", 3)]
    out, status = ladder.read_ladder([("1", "."), ("2", "."), ("1", ".")])
    assert out[2][2] == "illegal_restart" and status == "parsed_with_violations"


def test_ladder_over_documents(spark):
    df = spark.createDataFrame([(1, i, v, ".") for i, v in enumerate(["1", "2", "4"])] + [(2, 0, "9", ".")], "doc_id int, seq long, value string, punct string")
    got = {(r.doc_id, r.seq): r.action for r in ladder.heading_ladder(df).collect()}
    assert got == {(1, 0): "open_level", (1, 1): "increment", (1, 2): "jump_forward", (2, 0): "open_midcounter"}


def test_font_sizes_quality_and_joins(spark):
    spans = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(t).alias("text"), F.lit(sup).alias("superscript")) for s, t, sup in [(10.0, "abcd", False), (12.0, "abcd", False), (6.0, "1", True)]])
    assert one(spark, stats.line_font_size(spans)) == 12.0 and one(spark, stats.mid_font_size(spans)) == 11.0
    assert one(spark, T.joined_lines(F.array(*map(F.lit, ["An exam-", "ple of", "", "Anti-", "Trust"])))) == "An example of Anti- Trust"
    assert one(spark, T.text_quality(F.array(F.lit("x" * 200)))) == 1.0
    assert one(spark, T.text_quality(F.array(F.lit("")))) == 0.0
    assert one(spark, stats.longest_label_run(F.array(*map(F.lit, [1, 2, 9, 3, 4, 20, 6])))) == 5
    assert one(spark, shapes.roman_value(F.lit("xiv"))) == 14 and one(spark, shapes.roman_value(F.lit("abc"))) is None
    assert one(spark, T.note_label(F.lit(" ⁰¹² "))) == "12"


def test_overlap_measures(spark):
    a = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 10, 10))))
    b = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (5, 0, 15, 10))))
    assert one(spark, geometry.iou(a, b)) == pytest.approx(1 / 3)


def page_lines(spark, rows):
    return spark.createDataFrame(rows, f"doc_id int, page_index int, line_id string, text string, bbox {BOX}, reading_order int, region_type string, block_index int, page_number int")


def test_repeated_heads_need_one_place(spark):
    rows = [(1, p, f"a{p}", f"Chapter {p}", (100.0, 20.0, 200.0, 30.0), 0, "unknown", 0, p + 1) for p in range(6)]
    rows += [(1, p, f"b{p}", "Elsewhere", (100.0, 700.0 + 30.0 * p, 200.0, 790.0), 1, "unknown", 1, p + 1) for p in range(6)]
    df = page_lines(spark, rows)
    pages = df.select("doc_id", "page_index", "page_number").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    got = furniture.repeated_lines(df.drop("page_number"), pages).collect()
    assert {r.line_id for r in got} == {f"a{p}" for p in range(6)}


def test_alternating_folios(spark):
    rows = [(1, p, f"f{p}", str(p + 11), ((20.0 if p % 2 else 560.0), 770.0, (30.0 if p % 2 else 570.0), 780.0), 0, "unknown", 0, p + 1) for p in range(5)]
    df = page_lines(spark, rows)
    pages = df.select("doc_id", "page_index", "page_number").withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    assert {r.line_id for r in furniture.folio_runs(df.drop("page_number"), pages).collect()} == {f"f{p}" for p in range(5)}
    assert furniture.folio_runs(df.where("page_index < 3").drop("page_number"), pages).count() == 0


def test_paragraphs_and_regions(spark):
    rows = [(1, 0, "l0", "Head", (0.0, 0.0, 9.0, 1.0), 0, "heading", 0, 1), (1, 0, "l1", "An exam-", (0.0, 2.0, 9.0, 3.0), 1, "body", 1, 1), (1, 0, "l2", "ple.", (0.0, 3.0, 9.0, 4.0), 2, "body", 1, 1), (1, 0, "l3", "1 note", (0.0, 8.0, 9.0, 9.0), 3, "footnote", 2, 1)]
    df = page_lines(spark, rows).withColumn("exclude_from_body", F.lit(False))
    assert [(r.paragraph_id, r.text) for r in regions.paragraphs(df).orderBy("ordinal").collect()] == [("para-000001", "Head"), ("para-000002", "An example.")]
    assert regions.region_islands(df).count() == 3


def test_columns_are_read_one_after_another(spark):
    rows = [(1, 0, f"{side}{i}", "x", ((0.0 if side == "L" else 320.0), 100.0 + 20 * i, (280.0 if side == "L" else 600.0), 110.0 + 20 * i), 0, "body", 0, 1) for side in "LR" for i in range(4)]
    rows.append((1, 0, "T", "x", (0.0, 10.0, 600.0, 20.0), 0, "body", 0, 1))
    df = page_lines(spark, rows)
    pages = df.select("doc_id", "page_index").distinct().withColumn("width", F.lit(600.0))
    models = layout.column_models(df, pages)
    assert [(m.kind, m.split_x, m.crossings) for m in models.collect()] == [("two_column", 300.0, 0)]
    order = [r.line_id for r in layout.column_order(df, models).orderBy("reading_order").collect()]
    assert order == ["T", "L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3"]


def test_greedy_suppression(spark):
    rows = [(1, 0, "a", 0.9, (0.0, 0.0, 10.0, 10.0)), (1, 0, "b", 0.8, (1.0, 1.0, 11.0, 11.0)), (1, 0, "c", 0.7, (20.0, 0.0, 30.0, 10.0))]
    df = spark.createDataFrame(rows, f"doc_id int, page_index int, box_id string, score double, bbox {BOX}")
    assert {r.box_id for r in layout.suppress_overlaps(df).collect()} == {"a", "c"}


def test_parallel_columns(spark):
    english, french = "the act of this is not for any of the", "le la les des du de et une est pour dans"
    rows = [(1, 0, "e", english, 0), (1, 0, "f", french, 1), (1, 1, "g", french, 1), (2, 0, "h", french, 1)]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, line_id string, text string, column_no int")
    assert {r.line_id for r in layout.translation_lines(df).collect()} == {"f", "g"}


def test_chains_and_pairs(spark):
    assert notes.best_chain([(1, 0, 1.0), (2, 1, 1.0), (9, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0)]) == [0, 1, 3, 4]
    assert notes.best_chain([]) == []
    labels = spark.createDataFrame([(1, v, 0, 100 + v, 1.0, f"L{v}") for v in (1, 2, 3)], "doc_id int, value int, page_index int, place long, score double, label_id string")
    refs = spark.createDataFrame([(1, 1, 0, 5, "R1"), (1, 2, 0, 9, "R2"), (1, 2, 0, 50, "R2b")], "doc_id int, value int, page_index int, place long, ref_id string")
    got = {r.label_id: (r.chain, r.ref_id) for r in notes.pair_notes(labels, refs).collect()}
    assert got == {"L1": (0, "R1"), "L2": (0, "R2b"), "L3": (0, None)}


def test_propositions_and_marks(spark):
    df = spark.createDataFrame([(1, 1, "It began. The court held so.⟦FN:p1⟧ Then it ended⟦FN:p2⟧ at last. Done.")], "doc_id int, ordinal int, text string")
    got = {r.pair_id: (r.sentence, r.passage) for r in notes.propositions(df).collect()}
    assert got["p2"] == ("Then it ended at last.", "Then it ended") and got["p1"][0] == "The court held so."
    marks = {r.pair_id: (r.note_number, r.offset) for r in notes.renumbered(df).collect()}
    assert marks == {"p1": (1, 28), "p2": (2, 42)}


def test_crossrefs_are_scoped_to_their_sequence(spark):
    rows = [(1, "a", "1", "supra note 2", 0), (1, "b", "2", "x", 0), (1, "c", "2", "see also footnote 9", 1), (1, "d", "3", "op. cit., note 2", 1)]
    got = {r.source_pair_id: (r.kind, r.resolved, r.target_pair_id, r.target_count) for r in notes.crossrefs(spark.createDataFrame(rows, "doc_id int, pair_id string, label string, body string, restart_sequence int")).collect()}
    assert got == {"a": ("supra", True, "b", 2), "c": ("see_footnote", False, "", 0), "d": ("op_cit", True, "c", 2)}


UNITS = "doc_id int, kind string, ordinal int, unit_id string, label string, aliases array<string>, locator_kind string, occurrence int, pages array<int>, text string"
REQUESTS = "request_id string, doc_id int, kind string, locator string, end_locator string, context int, page int, occurrence int"


def test_lookup_statuses(spark):
    units = [(1, "page", i, f"p{i}", str(i), [], None, 1, [i], f"page {i}") for i in range(1, 30)]
    units += [(1, "paragraph", i, f"q{i}", "", [], None, 1, [1], f"para {i}") for i in range(1, 4)]
    units += [(1, "footnote", 1, "n1", "1", [], None, 1, [1], "first"), (1, "footnote", 2, "n2", "1", [], None, 2, [2], "again"), (1, "footnote", 3, "n3", "2", [], None, 1, [2], "")]
    units += [(1, "section", 1, "s1", "16A", ["16 A"], "section", 1, [1], "text"), (1, "section", 2, "s2", "3", [], "rule", 1, [1], "rule text")]
    asks = [
        ("range", 1, "page", "pages 2-3", "", 1, None, None), ("far", 1, "page", "99", "", 0, None, None), ("back", 1, "page", "3-2", "", 0, None, None), ("wide", 1, "page", "1-25", "", 0, None, None),
        ("para", 1, "paragraph", "¶ 2", "3", 0, None, None), ("two", 1, "footnote", "note 1", "", 0, None, None), ("one", 1, "footnote", "fn. 1", "", 0, None, 2), ("blank", 1, "footnote", "2", "", 0, None, None),
        ("sec", 1, "section", "16 a", "", 0, None, None), ("rule", 1, "rule", "3", "", 0, None, None), ("norule", 1, "rule", "16A", "", 0, None, None), ("none", 1, "article", "1", "", 0, None, None), ("kind", 1, "verse", "1", "", 0, None, None), ("ends", 1, "section", "3", "4", 0, None, None), ("ctx", 1, "page", "2", "", 3, None, None),
    ]
    got = {r.request_id: r for r in lookup.lookup(spark.createDataFrame(units, UNITS), spark.createDataFrame(asks, REQUESTS)).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "range": "found", "far": "not_found", "back": "invalid", "wide": "invalid", "para": "found", "two": "ambiguous", "one": "found", "blank": "unavailable",
        "sec": "found", "rule": "found", "norule": "not_found", "none": "unavailable", "kind": "invalid", "ends": "invalid", "ctx": "invalid",
    }
    assert (got["range"].before, got["range"].selected, got["range"].after) == (["page 1"], ["page 2", "page 3"], ["page 4"])
    assert got["two"].matches == ["n1", "n2"] and got["one"].matches == ["n2"] and got["para"].selected == ["para 2", "para 3"]


def test_export_nests_the_tree(spark):
    text = "1. One.—(1) First\n(a) clause\n(i) sub\nProvided that x\n2. Two.—body"
    parsed = statute.parse(lines.text_lines(spark.createDataFrame([(7, text)], "doc_id int, text string")))
    body = export.nested(statute.provisions(parsed))
    out = json.loads(export.statute_json(statute.metadata(parsed), body).first().json)
    act = out["akomaNtoso"]["act"]
    assert out["schema_version"] == "akn.statute.v1" and [s["eid"] for s in act["body"]] == ["sec_1", "sec_2"]
    sub = act["body"][0]["children"][0]
    assert [c["eid"] for c in sub["children"]] == ["sec_1__subsec_1__cl_a", "sec_1__subsec_1__proviso_1"]
    assert sub["children"][0]["children"][0]["eid"] == "sec_1__subsec_1__cl_a__subcl_i"


def test_json_of_many_documents_is_one_parse_without_joins(spark):
    from lexweave.plans import catalog, synthetic

    plan = catalog.queries()["statute_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    parsed = statute.parse(synthetic.act_lines(spark, "/root/testdata/sf0.001").where("doc_id <= 60"))

    def tree(rows, holder=None):
        return [{f: r[f] for f in export.NODE_FIELDS} | {"children": tree(rows, r.seq)} for r in rows if r.holder == holder]

    whole = {r.doc_id: r.json for r in export.document_json(parsed).collect()}
    assert whole == {r.doc_id: r.json for r in export.statute_json(statute.metadata(parsed), export.nested(statute.provisions(parsed))).collect()}
    for r in parsed.collect():
        assert json.loads(whole[r.doc_id])["akomaNtoso"]["act"]["body"] == tree(r.provisions)


def test_json_keeps_levels_of_any_depth_and_documents_without_provisions(spark):
    deep = [(None if d % 8 == 0 else d - 1, d, d % 8, f'e"{d}\n', "section", None, None, "x", None, [1]) for d in range(16)]
    fields = "holder int, seq int, depth int, eid string, kind string, num string, heading string, text string, parent_eid string, page_numbers array<int>"
    docs = spark.createDataFrame([(1, deep), (2, []), (None, deep[:1])], f"doc_id long, provisions array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    found = {r.doc_id: json.loads(r.json)["akomaNtoso"]["act"]["body"] for r in export.document_json(docs).collect()}
    assert found[2] == [] and [n["eid"] for n in found[None]] == ['e"0\n']
    for k, node in enumerate(found[1]):
        for d in range(8 * k, 8 * k + 8):
            assert node["eid"] == f'e"{d}\n' and len(node["children"]) == (d % 8 < 7)
            node = (node["children"] or [None])[0]
    assert {r.doc_id: json.loads(r.body) for r in export.nested(statute.provisions(docs)).collect()}[1] == found[1]


def test_text_units_count_utf16(spark):
    p = spark.createDataFrame([(1, 1, 0, "a🙂b⟦FN:x⟧ c")], "doc_id int, ordinal int, page_index int, text string")
    n = spark.createDataFrame([(1, 1, "note", [2, 1, 2])], "doc_id int, number int, text string, pages array<int>")
    rows = {r.kind: r for r in export.text_units(p, n).collect()}
    assert rows["body"].text == "a🙂b c" and rows["body"].references[0].offset == 4
    assert rows["footnote"].pages == [1, 2]


def test_constraints_and_status(spark):
    pages = spark.createDataFrame([(1, 0), (1, 0), (2, 0)], "doc_id int, page_index int")
    rows = spark.createDataFrame([(1, 0, "a", "xy", [(0, 3)]), (2, 1, "b", "xy", [(0, 2)])], "doc_id int, page_index int, line_id string, text string, spans array<struct<start:int,end:int>>")
    nodes = spark.createDataFrame([(1, "n", "gone", 5, 1)], "doc_id int, id string, parent_id string, start int, end int")
    assert {(r.doc_id, r.rule) for r in corpus.violations(pages, rows, nodes).collect()} == {(1, "page_repeats"), (2, "line_without_page"), (1, "span_outside_line"), (1, "node_without_parent"), (1, "node_range")}
    seen = spark.createDataFrame([(1, "OCR_REQUIRED", "warning", 0)], "doc_id int, code string, severity string, page_index int")
    assert {r.doc_id: r.status for r in corpus.status(pages.distinct(), seen).collect()} == {1: "ocr_required", 2: "ready"}
