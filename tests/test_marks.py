import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import marks

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SCHEMA = f"doc_id int, page_index int, line_id string, source_index int, block_index int, reading_order int, text string, bbox {BOX}, region_type string, note_region_mode string, exclude_from_body boolean, spans array<struct<text:string,bbox:{BOX},size:double,superscript:boolean,start:int,end:int>>"


def frame(spark, *rows):
    made = []
    for k, (line_id, text, box, size, *rest) in enumerate(rows):
        region, page = (rest + ["body", 0][len(rest) :])[:2] if rest else ("body", 0)
        made.append((1, page, line_id, k, 0, k, text, box, region, "", False, [(text, box, size, size < 7, 0, len(text))]))
    return spark.createDataFrame(made, SCHEMA)


def pages(spark, n=1):
    return spark.createDataFrame([(1, p, 600.0, 800.0, None) for p in range(n)], "doc_id int, page_index int, width double, height double, separator_y double")


def test_detached_marks_take_the_nearest_line(spark):
    df = frame(spark, ("a", "left words", (50.0, 100.0, 200.0, 110.0), 10.0), ("b", "right words", (230.0, 100.0, 400.0, 110.0), 10.0), ("m", "7", (201.0, 99.0, 205.0, 104.0), 5.0), ("low", "8", (201.0, 780.0, 205.0, 785.0), 5.0))
    assert [(r.source_line_id, r.line_id, r.note_id, r.offset) for r in marks.detached_references(df, pages(spark)).collect()] == [("m", "a", "7", 10)]


def test_spliced_marks_need_one_host(spark):
    df = frame(spark, ("a", "words", (50.0, 100.0, 200.0, 112.0), 10.0), ("m", "7", (201.0, 100.0, 205.0, 105.0), 5.0), ("b", "below", (50.0, 120.0, 200.0, 132.0), 10.0))
    assert [(r.source_line_id, r.line_id, r.offset) for r in marks.spliced_markers(df).collect()] == [("m", "a", 5)]


def test_endnotes_go_on_with_the_next_number(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [("h", "Notes", box, 10.0, "heading", 0), ("a", "1 First", box, 10.0, "footnote", 0), ("b", "2 Second", box, 10.0, "footnote", 1), ("c", "9 Other", box, 10.0, "footnote", 2), ("d", "body", box, 10.0, "body", 3), ("e", "1 New", box, 10.0, "footnote", 4)]
    got = {r.page_index: r.mode for r in marks.note_modes(frame(spark, *rows)).collect()}
    assert got == {0: "endnote", 1: "endnote", 2: "footnote_continuation", 4: ""}


def test_the_rule_above_the_notes(spark):
    df = frame(spark, ("a", "x" * 50, (50.0, 100.0, 500.0, 110.0), 10.0), ("u", "underlined words here", (50.0, 480.0, 500.0, 500.0), 10.0), ("n", "1 Note text", (50.0, 610.0, 300.0, 618.0), 8.0))
    rules = spark.createDataFrame([(1, 0, 50.0, 250.0, 600.0), (1, 0, 50.0, 250.0, 490.0), (1, 0, 50.0, 100.0, 605.0), (1, 0, 50.0, 250.0, 300.0)], "doc_id int, page_index int, x0 double, x1 double, y double")
    assert [r.separator_y for r in marks.separators(df, pages(spark), rules).collect()] == [600.0]


def test_drop_caps_move_before_their_line(spark):
    df = frame(spark, ("a", "he rest of the word", (80.0, 100.0, 300.0, 110.0), 10.0), ("b", "goes on", (80.0, 115.0, 300.0, 125.0), 10.0), ("c", "T", (50.0, 98.0, 75.0, 128.0), 30.0), ("d", "plain", (50.0, 140.0, 300.0, 150.0), 10.0))
    assert [r.line_id for r in marks.drop_caps(df).orderBy("place").collect()] == ["c", "a", "b", "d"]


def test_heads_grow_line_by_line(spark):
    df = frame(spark, ("h", "ACT", (100.0, 10.0, 200.0, 18.0), 8.0, "header"), ("i", "Chapter", (100.0, 20.0, 180.0, 28.0), 8.0), ("j", "Section", (100.0, 30.0, 180.0, 38.0), 8.0), ("k", "far", (400.0, 60.0, 500.0, 68.0), 8.0), ("b", "body", (100.0, 200.0, 500.0, 210.0), 10.0))
    assert sorted(r.line_id for r in marks.running_heads(df, pages(spark)).collect()) == ["i", "j"]


def test_labels_stand_with_their_bodies(spark):
    df = frame(spark, ("b", "the body of the note", (80.0, 100.0, 300.0, 110.0), 8.0), ("l", "1", (50.0, 103.0, 55.0, 108.0), 5.0), ("z", "later", (50.0, 101.0, 300.0, 101.5), 8.0))
    models = spark.createDataFrame([], "doc_id int, page_index int, kind string, split_x double")
    assert [r.line_id for r in marks.note_order(df, models).orderBy("rank").collect()] == ["l", "b", "z"]


def test_words_and_regions(spark):
    df = frame(spark, ("a", "ab  c", (0.0, 0.0, 50.0, 10.0), 10.0))
    assert [(r.word, r.bbox.x0, r.bbox.x1) for r in marks.word_boxes(df).orderBy("pos").collect()] == [("ab", 0.0, 20.0), ("c", 40.0, 50.0)]
    assert marks.known_regions(df).count() == 1 and marks.known_regions(df.withColumn("region_type", F.lit("unknown"))).count() == 0


def test_ctc_and_thresholds():
    steps = [1, 1, 0, 1, 2, 2]
    logits = np.zeros((3, 6), np.float32)
    logits[steps, range(6)] = 5
    assert [label for label, _ in marks.ctc_labels(logits, 6)] == [1, 1, 2]
    assert marks.ctc_labels(logits, 2)[0][1] == pytest.approx(np.exp(5) / (np.exp(5) + 2), rel=1e-5)
    assert marks.otsu_threshold(np.array([[10, 10, 200, 200]], np.uint8)) == 10 and marks.otsu_threshold(np.zeros((0, 0))) == 128
