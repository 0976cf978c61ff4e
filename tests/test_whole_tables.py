"""Queries over whole tables against plain Python."""

from collections import defaultdict

from lexweave.operators import corpus
from lexweave.plans import catalog
from lexweave.plans.synthetic import LINES

SF = "/root/testdata/sf0.001"


def test_retention_of_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    newest = sorted(orders.collect(), key=lambda r: (-r.o_orderdate.timestamp(), r.o_orderkey))
    cache = orders.selectExpr("o_orderkey AS path", "o_custkey AS bytes", "o_orderdate AS modified")
    for limit in (0, 5_000, 100_000, 10**9):
        held, expected = 0, set()
        for r in newest:
            held += r.o_custkey
            if held <= limit:
                expected.add(r.o_orderkey)
        assert {r.path for r in corpus.retained(cache, limit).collect()} == expected
        if limit == 100_000:
            assert {r.path for r in catalog.queries()["cache_retention"](spark, SF).collect()} == expected


def test_joined_page_text_keeps_wrapped_words_and_nulls(spark, tmp_path):
    texts = ["an exam-\nple of it", "Non-\n EU goods", "a dash -\n\n goes on", "fine\n\n text ", "", None, "one-\ntwo-\nthree"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def joined(text):
        done = ""
        for t in (x.strip(" ") for x in text.split("\n")):
            if t:
                done = done[:-1] + t if done.endswith("-") and t[0].islower() else f"{done} {t}".lstrip(" ")
        return done

    got = {r.doc_id: r.n for r in catalog.queries()["joined_page_text"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else len(joined(t)) for k, t in enumerate(texts)}


def test_contents_rows_of_every_page(spark):
    pages = defaultdict(list)
    for r in LINES.frame(spark, SF).select("doc_id", "page_index", "line_id", "region_type").collect():
        pages[r.doc_id, r.page_index].append(r)
    listed = {k: [r.line_id for r in rows if r.region_type not in ("header", "footer")] for k, rows in pages.items()}
    expected = {(*k, line, len(ids)) for k, ids in listed.items() if len(ids) >= 5 for line in ids}
    assert any(n < 8 for *_, n in expected)
    assert {tuple(r) for r in catalog.queries()["contents_rows"](spark, SF).collect()} == expected


def test_pdf_acceptance_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    content = {r.doc_id: (r.text or "").encode() + (b"%PDF-1.7" if r.doc_id % 2 == 0 else b"PDF") for r in docs if r.text is not None}
    expected = {k for k, c in content.items() if b"%PDF-" in c[:1024]}
    assert 0 < len(expected) < sum(r.doc_id % 2 == 0 for r in docs)
    assert {r.doc_id for r in catalog.queries()["pdf_acceptance"](spark, SF).collect()} == expected


def test_nearest_note_bodies_of_all_lines(spark):
    pages = defaultdict(list)
    for r in LINES.frame(spark, SF).collect():
        pages[r.doc_id, r.page_index].append(r)
    expected = set()
    for k, rows in pages.items():
        for a in rows:
            met = []
            for b in rows:
                y0, y1 = b.y0 - b.k % 3 * 78, b.y1 - b.k % 3 * 78
                shared, low = min(a.y1, y1) - max(a.y0, y0), min(a.y1 - a.y0, y1 - y0)
                if a.line_id != b.line_id and b.x0 >= a.x0 and shared > 0 and low > 0 and shared / low >= 0.5:
                    met.append((max(b.x0 - a.x1, 0), abs(y0 - a.y0), b.line_id))
            if met:
                expected.add((*k, a.line_id, min(met)[2]))
    assert {tuple(r) for r in catalog.queries()["nearest_note_bodies"](spark, SF).collect()} == expected
