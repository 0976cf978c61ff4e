import pytest
from pyspark.sql import functions as F

from lexweave.operators import citations, lines, statute

HIERARCHY = """16. Eligibility and conditions for taking input tax credit.—(1) Every registered person shall be entitled to take credit as in section 49.
(2) Notwithstanding anything contained in this section, no registered person shall be entitled to the credit unless,—
(a) he is in possession of a tax invoice;
(b) 1[he has received the goods in accordance with rule 36(4).]
(c) subject to the provisions of section 49, the tax has been paid;
(d) he has furnished the return under section 39.
Provided that where the goods are received in lots, the person shall be entitled upon receipt of the last lot:
Provided further that where a recipient fails to pay, the amount shall be added.
Explanation 1.—For the purposes of this sub-section, goods shall be deemed to have been received.
22. Persons liable for registration.—(1) Every supplier shall be liable to be registered under this Act.
24. Compulsory registration.—Notwithstanding anything contained in sub-section (1) of section 22, the following shall be registered.
1. Subs. by Act 12 of 2020, s. 118, for "sub-section (4)" (w.e.f. 1-1-2021)."""

LONG = """THE CENTRAL GOODS AND SERVICES TAX ACT, 2017
Act 12 of 2017
An Act to make a provision for levy and collection of tax
BE it enacted by Parliament as follows:--
CHAPTER I
PRELIMINARY
1. Short title.-This Act may be called the Act.
2. Definitions.-In this Act, unless the context otherwise requires, the assigned meaning prevails.
CHAPTER II
RATES
4. Levy.-Tax shall be levied.
5. Valuation.-The value shall be the transaction value."""


def read(text):
    return statute.read_document([(line.strip(), 1, "unknown") for line in text.splitlines() if line.strip()])


def eids(text):
    return [p["eid"] for p in read(text)["provisions"]]


def test_hierarchy():
    out = read(HIERARCHY)
    by = {p["eid"]: p for p in out["provisions"]}
    assert [p["eid"] for p in out["provisions"] if p["depth"] == 0] == ["sec_16", "sec_22", "sec_24"]
    assert by["sec_16"]["text"] == "" and by["sec_16"]["heading"].startswith("Eligibility")
    assert by["sec_16__subsec_2__expl_1"]["parent_eid"] == "sec_16__subsec_2"
    assert {"sec_16__subsec_2__cl_b", "sec_16__subsec_2__proviso_1", "sec_16__subsec_2__proviso_2"} <= set(by)
    assert out["notes"][0]["associated_eid"] == "sec_16__subsec_2__cl_b"
    assert len(by) == len(out["provisions"])


def test_tables_in_spark(spark):
    docs = spark.createDataFrame([(1, HIERARCHY), (2, LONG)], "doc_id long, text string")
    parsed = statute.parse(lines.text_lines(docs)).cache()
    provisions = statute.provisions(parsed)
    found = citations.resolve(citations.extract_citations(provisions), provisions)
    got = {(r.parent_eid, r.target_eid): r for r in found.collect()}
    reverse = got["sec_24", "sec_22__subsec_1"]
    assert (reverse.relation, reverse.resolved, reverse.external) == ("notwithstanding", True, False)
    rule = got["sec_16__subsec_2__cl_b", "rule_36__subrule_4"]
    assert (rule.resolved, rule.external, rule.target_type) == (False, True, "rule")
    assert not got["sec_16__subsec_1", "sec_49"].resolved
    own = statute.citations(statute.parse(lines.text_lines(docs), cite=True))
    assert sorted(map(str, own.select(found.columns).collect())) == sorted(map(str, found.collect()))
    note = statute.footnotes(parsed).where("doc_id = 1").first().amendment
    assert (note.footnote_number, note.action, note.amending_act, note.amending_section, note.effective_date, note.substituted_for) == ("1", "substituted", "Act 12 of 2020", "s. 118", "1-1-2021", "sub-section (4)")
    assert statute.attached_amendments(statute.footnotes(parsed)).first().eid == "sec_16__subsec_2__cl_b"
    meta = {r.doc_id: r for r in statute.metadata(parsed, F.lit("Given")).collect()}
    assert (meta[2].title, meta[2].act_number, meta[2].act_year) == ("The Central Goods and Services Tax Act, 2017", "Act 12 of 2017", "2017")
    assert meta[1].title == "Given"
    assert [r.code for r in statute.diagnostics(parsed).where("doc_id = 2").collect()] == ["statute.preamble_recovered"]
    chapters = {r.eid: r.heading for r in provisions.where("doc_id = 2 and kind = 'chapter'").collect()}
    assert chapters == {"act_preamble": None, "chapter_1": "PRELIMINARY", "chapter_2": "RATES"}


def test_roman_letters_are_clauses_where_the_alphabet_expects_them():
    text = "1. A.—x\n" + "\n".join(f"({c}) t" for c in "abcdefgh") + "\n(i) ninth\n(i) sub\n(ii) sub\n(iii) sub\n(A) upper\n(j) tenth"
    out = eids(text)
    assert out[9:] == ["sec_1__cl_i", "sec_1__cl_i__subcl_i", "sec_1__cl_i__subcl_ii", "sec_1__cl_i__subcl_iii", "sec_1__cl_a__dup2", "sec_1__cl_j"]


def test_schedules_restart_and_sections_resume():
    out = eids("1. One.—x\nSCHEDULE I\n1. first\n(a) inside\n2. second\nSCHEDULE II\n1. again\n9. Nine.—resumes")
    assert out == ["sec_1", "schedule_1", "schedule_1__item_1", "schedule_1__item_1__cl_a", "schedule_1__item_2", "schedule_2", "schedule_2__item_1", "sec_9"]


@pytest.mark.parametrize("line", ["1.5 per cent of value", "2019. The Government may act", "Chapter IV-D;", "(No. 31 of 2018) amends"])
def test_lines_that_open_nothing(line):
    assert eids(f"1. One.—text follows\n{line}") == ["sec_1"]


def test_duplicates_stubs_and_orphans():
    out = read("7.\n8. Eight.—x\n7. Seven.—real\n8. Eight again.—more")
    assert [p["eid"] for p in out["provisions"]] == ["sec_8", "sec_7"]
    assert [d["code"] for d in out["diagnostics"]] == ["statute.empty_section_stub_replaced", "statute.duplicate_section_number"]
    out = read("(1) no section\nProvided that x")
    assert [(p["eid"], p["parent_eid"]) for p in out["provisions"]] == [("sec_unknown__subsec_1", None), ("sec_unknown__subsec_1__proviso_1", "sec_unknown__subsec_1")]


@pytest.mark.parametrize(
    "text, target, kind",
    [
        ("Notwithstanding anything contained in sub-section (1) of section 22, x", "sec_22__subsec_1", "notwithstanding"),
        ("Subject to clause (b) of sub-section (2) of section 16, y", "sec_16__subsec_2__cl_b", "subject_to"),
        ("the proviso to section 16", "sec_16__proviso_1", "reference"),
        ("twenty-first proviso to section 16", "sec_16__proviso_21", "reference"),
        ("gobbledy proviso to section 16", "sec_16", "reference"),
        ("Explanation 2 to clause (b) of section 17", "sec_17__cl_b__expl_2", "reference"),
        ("section 16(2)(b)(i)", "sec_16__subsec_2__cl_b__subcl_i", "reference"),
        ("rule 36(4)", "rule_36__subrule_4", "reference"),
    ],
)
def test_citation_forms(text, target, kind):
    found = citations.find_citations(text)
    assert (found[0]["target_eid"], found[0]["relation"]) == (target, kind)
    assert text[found[0]["span_start"] : found[0]["span_end"]] == found[0]["raw_text"]


def test_external_acts_and_enumerations():
    one = citations.find_citations("section 5 of the Integrated Goods and Services Tax Act, 2017")
    assert one[0]["external"] and one[0]["target_type"] == "external_act" and one[0]["span_end"] == 60
    many = citations.find_citations("sections 16, 17 and 18A, 19, 20")
    assert [c["target_eid"] for c in many] == ["sec_16", "sec_17", "sec_18a", "sec_19"]


def test_broken_quotation_font(spark):
    broken = "".join(f"―word{i}‖ " for i in range(5))
    df = spark.createDataFrame([(1, broken), (2, "a ― b"), (3, broken + "“x” “y”")], "doc_id int, text string")
    flags = {r.doc_id: r.broken for r in lines.broken_font(df).collect()}
    assert flags == {1: True, 2: False, 3: False}
    fixed = df.join(lines.broken_font(df).select("doc_id", "broken"), "doc_id").select("doc_id", lines.repaired(F.col("text"), F.col("broken")).alias("t"))
    got = {r.doc_id: r.t for r in fixed.collect()}
    assert got[1].startswith("“word0” ") and got[2] == "a ― b" and "―word0”" in got[3]


def test_note_marks_in_page_lines(spark):
    span = "array<struct<text:string,start:int,end:int,superscript:boolean>>"
    df = spark.createDataFrame([("é India [***]1 and 2", [("1", 13, 14, True), ("2", 19, 20, True), ("x", 0, 1, True)])], f"text string, spans {span}")
    assert df.select(lines.marked(F.col("text"), F.col("spans")).alias("t")).first().t == "é India [***][1] and [2]"
