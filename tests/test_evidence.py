"""Operators over typography, markers, detections and units against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexweave import storage
from lexweave.functions import locators, shapes, stats
from lexweave.operators import candidates, corpus, furniture, insets, ladder, layout, lookup, notes
from lexweave.sources import docx, files


def chain_by_pairs(items):
    """The best chain by looking at every pair."""
    best = []
    for i, (value, _, score) in enumerate(items):
        options = [(best[j][0] - (value - items[j][0] - 1) / 4, j) for j in range(i) if items[j][0] < value]
        top = max(options, default=(0.0, -1))
        best.append((score + max(top[0], 0.0), top[1] if top[0] > 0 else -1))
    at = max(range(len(best)), key=lambda i: best[i][0]) if best else -1
    out = []
    while at >= 0:
        out.append(at)
        at = best[at][1]
    return out[::-1]


@pytest.mark.parametrize("seed", range(40))
def test_the_best_chain_is_that_of_all_pairs(seed):
    rng = random.Random(seed)
    items = [(rng.randint(1, 9), k, rng.choice([0.25, 0.5, 1.0, 2.0, -0.5])) for k in range(rng.randint(0, 30))]
    assert notes.best_chain(items) == chain_by_pairs(items)


def test_a_chain_of_many_labels_takes_no_square_of_them():
    items = [(k % 5000, k, 1.0) for k in range(60_000)]
    assert len(notes.best_chain(items)) == 5000


def test_the_longest_run_of_labels(spark):
    rng = random.Random(3)
    rows = [(k, [rng.randint(1, 12) for _ in range(rng.randint(0, 15))]) for k in range(60)]

    def longest(v):
        n = []
        for i, x in enumerate(v):
            n.append(1 + max([n[j] for j in range(i) if 1 <= x - v[j] <= 3], default=0))
        return max(n, default=0)

    got = {r.k: r.n for r in spark.createDataFrame(rows, "k int, v array<int>").select("k", stats.longest_label_run(F.col("v")).alias("n")).collect()}
    assert got == {k: longest(v) for k, v in rows}


def test_latencies_by_rank_with_ties_nulls_and_few_rows(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 3000):
        values = [round(rng.random() * 3, 1) if n > 7 else rng.random() for _ in range(n)]
        rows = [(v, 2, 1.0, 4.0) for v in values] + [(None, 1, 1.0, 4.0)]
        told = corpus.latency_summary(spark.createDataFrame(rows, "seconds double, lines int, used double, padded double")).first()
        s = sorted(values)
        at = lambda p: s[-(-(len(s) - 1) * p // 100)]
        assert (told.batches, told.lines, told.padding, told.p50, told.p95) == (n + 1, 2 * n + 1, 0.75, at(50), at(95))
    assert corpus.latency_summary(spark.createDataFrame([], "seconds double, lines int, used double, padded double")).first().p50 is None


def test_repeated_lines_at_any_height(spark):
    rng = random.Random(5)
    rows, pages = [], []
    for d in range(6):
        for p in range(12):
            pages.append((d, p, p + 1, 600.0, 800.0))
            for _ in range(rng.choice([0, 1, 1, 2])):
                y, x = rng.uniform(5, 70), rng.choice([100.0, 103.0, 300.0, rng.uniform(0, 400)])
                rows.append((d, p, f"l{len(rows)}", rng.choice(["Levy Act", "Other 12"]), (x, y, x + 50, y + 10)))
    lines = spark.createDataFrame(rows, "doc_id int, page_index int, line_id string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    sized = spark.createDataFrame(pages, "doc_id int, page_index int, page_number int, width double, height double")
    expected = set()
    for d in range(6):
        least = min(4, max(2, -(-12 * 35 // 100)))
        for key, text in (("levy act", "Levy Act"), ("other #", "Other 12")):
            hits = [(r[4][1] / 800, (r[4][0] + r[4][2]) / 2 / 600, r[1], r[2]) for r in rows if r[0] == d and r[3] == text]
            best = None
            for start in {h[0] for h in hits}:
                inside = [h for h in hits if start <= h[0] and h[0] - start <= 0.015]
                chosen = []
                for parity in (0, 1):
                    own = [h for h in inside if (h[2] + 1) % 2 == parity]
                    runs = [(len({h[2] for h in own if round(g[1] * 1e6) <= round(h[1] * 1e6) <= round(g[1] * 1e6) + 40_000}), g[1]) for g in own]
                    if runs:
                        x = max(runs)[1]
                        chosen += [h for h in own if h[1] >= x and h[1] - x <= 0.04]
                size = len({h[2] for h in chosen})
                if best is None or (size, -start) > best[0]:
                    best = ((size, -start), chosen)
            if best and best[0][0] >= least:
                expected |= {(d, h[3], best[0][0]) for h in best[1]}
    got = {(r.doc_id, r.line_id, r.pages) for r in furniture.repeated_lines(lines, sized).collect()}
    assert got == expected and expected


@pytest.mark.parametrize("raw, plain", [("Ｓｅｃｔｉｏｎ １６", "Section 16"), ("ﬁne № ½", "fine No 1⁄2"), ("plain", "plain"), ("¹²³", "123"), ("é", "é"), ("Ⅳ", "IV")])
def test_compatibility_forms(spark, raw, plain):
    assert spark.range(1).select(locators.compatible(F.lit(raw)).alias("t")).first().t == plain


def test_lookup_reads_full_width_locators(spark):
    units = spark.createDataFrame(
        [(1, "page", k, f"p{k}", str(k), [], None, 1, [k], f"page {k}") for k in (1, 2, 3)] + [(1, "section", 1, "s16", "Section １６", [], "section", 1, [1], "sixteen"), (1, "footnote", 1, "n1", "4", [], None, 1, [2], "a note"), (1, "paragraph", 1, "q1", "", [], None, 1, [1], "words")],
        "doc_id int, kind string, ordinal int, unit_id string, label string, aliases array<string>, locator_kind string, occurrence int, pages array<int>, text string",
    )
    asked = spark.createDataFrame([("a", 1, "page", "ｐｐ. ２–３", "", 0, None, None), ("b", 1, "section", "section 16", "", 0, None, None), ("c", 1, "footnote", "note 4", "", 0, None, None), ("d", 1, "paragraph", "para 1", "", 0, None, None)], "request_id string, doc_id int, kind string, locator string, end_locator string, context int, page int, occurrence int")
    got = {r.request_id: (r.status, r.selected) for r in lookup.lookup(units, asked).collect()}
    assert got == {"a": ("found", ["page 2", "page 3"]), "b": ("found", ["sixteen"]), "c": ("found", ["a note"]), "d": ("found", ["words"])}


def test_detections_by_class(spark):
    rng = random.Random(9)
    rows = []
    for d in range(20):
        for q in range(25):
            x, y = rng.uniform(0, 80), rng.uniform(0, 80)
            rows.append((d, 0, q, rng.randint(0, 2), rng.choice([0.1, 0.5, 0.5, 0.9, float("nan")]), (x, y, x + rng.choice([0, 20, 30]), y + 25)))
    boxes = spark.createDataFrame(rows, "doc_id int, page_index int, query int, label int, score double, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    expected = []
    for d in range(20):
        best = []
        for c in range(3):
            own = sorted((r for r in rows if r[0] == d and r[3] == c and r[4] > 0.3 and r[5][2] > r[5][0]), key=lambda r: (-r[4], r[2]))
            best += own[:5]
        kept = []
        for r in sorted(best, key=lambda r: (-r[4], r[3], r[2])):
            box = dict(zip(("x0", "y0", "x1", "y1"), r[5]))
            if len(kept) < 6 and all(k[0] != r[3] or layout.overlap(box, k[2]) <= 0.2 for k in kept):
                kept.append((r[3], r[2], box, r[4]))
        expected += [(d, i, k[1], k[0], k[3]) for i, k in enumerate(kept)]
    got = [(r.doc_id, r.rank, r["query"], r.label, r.score) for r in layout.class_detections(boxes, 5, 6, 0.3, 0.2).orderBy("doc_id", "rank").collect()]
    assert got == expected


def test_runs_of_markers(spark):
    text = "ab12c³⁴ 12345678 **†x⁰¹²³⁴"
    got = [tuple(r) for r in spark.range(1).select(F.inline(candidates.runs(F.lit(text)))).collect()]
    assert got == [("digits", 2, 4, "12"), ("raised", 5, 7, "³⁴"), ("symbols", 17, 20, "**†"), ("raised", 21, 25, "⁰¹²³"), ("raised", 25, 26, "⁴")]
    assert spark.range(1).select(F.size(candidates.runs(F.lit(""))).alias("n")).first().n == 0


def test_digests_of_files_once_for_each_path(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.pdf").write_bytes(b"one")
    found = files.read_binary(spark, str(tmp_path))
    rows = files.asset_digests(found.unionByName(found)).collect()
    assert len(rows) == 2 and len({r.sha256 for r in rows}) == 1


class Named:
    """Enough of a session to ask for its shared folder."""

    def __init__(self, master, session=None, context=None, checkpoint=None):
        self.master, self.checkpoint = master, checkpoint
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: session or default})()
        self.sparkContext = self
        self._context = context

    def getConf(self):
        return type("Conf", (), {"get": lambda _, key, default=None: self._context or default})()

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, path):
        self.checkpoint = path


def test_the_shared_folder():
    assert storage.shared_dir(Named("spark://x", session="hdfs://a/")) == "hdfs://a"
    assert storage.shared_dir(Named("spark://x", context="hdfs://b")) == "hdfs://b"
    assert storage.shared_dir(Named("spark://x", checkpoint="hdfs://c/d")) == "hdfs://c/d"
    assert storage.shared_dir(Named("local[4]")).startswith("file:///")
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(Named(master))


BODY = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:bookmarkStart w:id="7" w:name="SupraNote2"/><w:r><w:t>A</w:t></w:r><w:r><w:footnoteReference w:id="11"/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:footnoteReference w:id="12"/></w:r><w:r><w:footnoteReference w:id="11"/></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'


def test_bookmarks_round_first_references():
    xml, names, added = docx.with_bookmarks(BODY.encode(), [11, 12, 13], {1, 2, 3, 9})
    assert names == {1: "SupraNote1", 2: "SupraNote2"} and added == 1
    root = docx.ElementTree.fromstring(xml)
    first = root.find(f".//{docx.W}p")
    assert [e.tag.removeprefix(docx.W) for e in first] == ["bookmarkStart", "r", "bookmarkStart", "r", "bookmarkEnd"]
    assert [e.get(f"{docx.W}id") for e in first if "bookmark" in e.tag] == ["7", "8", "8"]
    assert docx.with_bookmarks(xml, [11, 12, 13], {1, 2})[2] == 0
    assert [docx.accepted_text(p) for p in docx.paragraphs_under(root)] == ["A", ""]


def test_numeric_outlines(spark):
    def page(n, texts, x=lambda t: 50.0):
        return [(1, n, k, f"{n}-{k}", t, x(t), 600.0) for k, t in enumerate(texts)]

    good = ["1. Levy of Tax", "1.1 General Part", "1.2 Special Part", "words", "2. Rates", "2.1 Low Rates"]
    rows = page(0, good) + page(1, good[::-1]) + page(2, good[:3]) + page(3, ["1. Levy of Tax", "2.1 General Part", "2.2 Special Part", "3. Rates"]) + page(4, good, lambda t: 50.0 + 30 * t.startswith("2.")) + page(5, ["1 Levy of Tax", *good[1:]])
    lines = spark.createDataFrame(rows, "doc_id int, page_index int, reading_order int, line_id string, text string, x0 double, page_width double")
    got = sorted((r.line_id, r.start, r.end, r.depth) for r in ladder.numeric_outlines(lines).collect())
    assert got == [("0-0", 0, 2, 1), ("0-1", 0, 3, 2), ("0-2", 0, 3, 2), ("0-4", 0, 2, 1), ("0-5", 0, 3, 2)]


def test_block_quotes_against_plain_python(spark):
    rng = random.Random(21)
    rows = []
    for p in range(120):
        y = 60.0
        for k in range(rng.randint(1, 14)):
            inset = rng.choice([0, 0, 0, 20, 40, 70])
            right = rng.choice([0, 0, 10, 40])
            column = rng.choice([0, 0, 0, 1])
            x0, x1 = (60 + inset, 290 - right) if column == 0 else (340 + inset, 560 - right)
            if rng.random() < 0.3 and column == 0:
                x1 = 540 - inset - right
            h = rng.choice([10, 25, 40])
            rows.append((1, p, k, rng.choice(["text"] * 7 + ["footnote"]), (float(x0), y, float(x1), y + h), rng.choice([0.1, 0.2, 0.9]), rng.randint(1, 4), 600.0, 800.0))
            y += h + rng.choice([2, 6, 30])

    def rank(values, f):
        values = sorted(values)
        return values[round((len(values) - 1) * f)]

    def below(box, column, notes):
        gaps = [n[4][1] - box[3] for n in notes if n[9] == column and -12 <= n[4][1] - box[3] <= 90 and max(0, min(box[2], n[4][2]) - max(box[0], n[4][0])) / max(1, min(box[2] - box[0], n[4][2] - n[4][0])) >= 0.08]
        return min(gaps) if gaps else None

    expected = {}
    for p in range(120):
        page = [(*r, int((r[4][0] + r[4][2]) / 2 > 324)) for r in rows if r[1] == p]
        notes = [r for r in page if r[3] == "footnote"]
        texts = sorted((r for r in page if r[3] == "text"), key=lambda r: (r[4][1], (r[4][0] + r[4][2]) / 2, r[4][0], r[2]))
        label = {r[2]: "text" for r in texts}
        if len(texts) >= 3:
            state = []
            for r in texts:
                near = below(r[4], r[9], notes) if r[5] <= 0.25 else None
                spill = near is not None and near <= 10
                own = [t for t in texts if t[9] == r[9]]
                score = 0.0
                if not spill and len(own) >= 3:
                    left, right, body = rank([t[4][0] for t in own], 0.1), rank([t[4][2] for t in own], 0.9), rank([t[4][2] - t[4][0] for t in own], 0.9)
                    part = lambda v, s: min(1, max(0, v / max(s, 22)))
                    score = 0.5 * part(body - (r[4][2] - r[4][0]), body * 0.18) + 0.35 * part(r[4][0] - left, 21) + 0.15 * part(right - r[4][2], 18)
                state.append((spill, score, score >= 0.45))
                if spill:
                    label[r[2]] = "footnote"
            i = 0
            while i < len(texts):
                j = i
                while state[i][2] and j + 1 < len(texts) and state[j + 1][2] and texts[j + 1][9] == texts[i][9]:
                    j += 1
                if state[i][2]:
                    group, scores = texts[i : j + 1], sorted(s[1] for s in state[i : j + 1])
                    m = len(scores)
                    score = (scores[m // 2] if m % 2 else (scores[m // 2 - 1] + scores[m // 2]) / 2) + min(0.025 * (m - 1), 0.1)
                    body = lambda k: 0 <= k < len(texts) and texts[k][9] == texts[i][9] and not state[k][2]
                    box = (min(g[4][0] for g in group), min(g[4][1] for g in group), max(g[4][2] for g in group), max(g[4][3] for g in group))
                    both, edge = body(i - 1) and body(j + 1), body(i - 1) and below(box, texts[i][9], notes) is not None
                    lines = sum(g[6] for g in group)
                    strong = (body(i - 1) or body(j + 1)) and score >= 0.76 and lines >= 3
                    if lines >= 2 and not (lines <= 2 and (score < 0.8 or not both)) and score >= (0.45 if both or edge else 0.68) and (both or edge or strong):
                        for g in group:
                            label[g[2]] = "block_quote"
                i = j + 1
        expected |= {(p, k): v for k, v in label.items()}
    regions = spark.createDataFrame(rows, "doc_id int, page_index int, region_id int, label string, bbox struct<x0:double,y0:double,x1:double,y1:double>, score double, line_count int, page_width double, page_height double")
    got = {(r.page_index, r.region_id): r.label for r in insets.block_quotes(regions).collect()}
    assert got == expected and set(expected.values()) == {"text", "footnote", "block_quote"}


def test_json_forms(spark):
    value = F.struct(F.lit("a, b: c").alias("text"), F.array(F.lit(1), F.lit(2)).alias("n"))
    row = spark.range(1).select(files.pretty_json(value).alias("pretty"), files.spaced_json(value).alias("spaced")).first()
    assert json.loads(row.pretty) == {"text": "a, b: c", "n": [1, 2]} and "\n" in row.pretty
    assert row.spaced == '{"text": "a, b: c", "n": [1, 2]}'


@pytest.mark.parametrize("text, heading", [("GENERAL PART", True), ("II. General Part", True), ("II. General Part.", False), ("a) of the whole", False), ("12 NOTE TEXT", False), ("", False), ("Plain words", False), ("X" * 91, False)])
def test_heading_styles(spark, text, heading):
    assert spark.range(1).select(shapes.heading_style(F.lit(text)).alias("h")).first().h == heading
