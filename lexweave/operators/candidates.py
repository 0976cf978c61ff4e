"""Candidates for notes and headings, note bodies, and decisions on page order and region labels."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import geometry as G
from lexweave.functions import shapes as S
from lexweave.functions import text as T
from lexweave.operators import layout

# --- Fixed values -----------------------------------------------------------------------------------

SANDWICH_BAND, TOP_BAND = 0.60, 0.30
CONTENTS_HEADINGS = ("contents", "table of contents", "table des matières", "table of provisions", "table analytique")
CONTENTS_ENTRIES, CONTENTS_WRAPPED = 5, 6
PAREN_LABELS, ENDNOTE_LABELS, ENDNOTE_TAIL, ENDNOTE_SHARE = 3, 4, 0.75, 0.7
ORDER_LINES, COLUMN_SWITCHES, LONG_RUN, SCRAMBLED = 8, 5, 6, 3
UNITS_AFTER = r"(?i)^[ \t]+(?:years?|days?|months?|weeks?|hours?|minutes?|seconds?|per|percent|p\.c\b|cents?|dollars?|pounds?|shillings?|pence|feet|foot|acres?|miles?|inches?|yards?|tons?|o.?clock)\b"
PROVISION_BEFORE = r"(?i)\b(?:ss?|sub-?ss?|arts?|paras?|cls?)\.?\s*$"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
LONGEST_DIGITS, LONGEST_RAISED, LONGEST_SYMBOLS = 7, 4, 8
NOTE_SCORE = 1.5

# ----------------------------------------------------------------------------------------------------

_DIGITS = re.compile(rf"[{SUPERSCRIPTS}]{{1,3}}|(?<![0-9,/:$-])(?<![0-9][.])[0-9]{{1,3}}(?![0-9.,/:%-]*[0-9%])")
_PINPOINT = re.compile(S.PATTERNS["pinpoint_abbreviation"])
_UNITS, _PROVISION = re.compile(UNITS_AFTER), re.compile(PROVISION_BEFORE)
_DAY_BEFORE, _DAY_AFTER = re.compile(rf"(?i)\b{S.MONTH}\.?[ \t]+$"), re.compile(rf"(?i)^[ \t]+{S.MONTH}\b[.,]?")
_PLAIN = str.maketrans(SUPERSCRIPTS, "0123456789")
_YEAR = re.compile(r"^,\s*(?:1[6-9]|20)\d\d\b")


def reference_candidates(text: str | None, superscripts: list[tuple[int, int]] = (), protected: list[tuple[int, int]] = ()) -> list[tuple[int, int, int, str, float]]:
    """Numbers of a body line that may refer to notes: start, end, value, form and score, the surest form of each.

    Superscripts are surest, then digits set against a word's end or its stop; digits by themselves score
    little. A number inside a protected span, after a provision's or pinpoint's abbreviation, before a unit or
    in a date is none.
    """
    text, out = text or "", []
    for m in _DIGITS.finditer(text):
        start, end = m.span()
        if any(start < b and a < end for a, b in protected):
            continue
        value = int(m[0].translate(_PLAIN))
        before, after = text[:start], text[end:]
        if not 1 <= value <= 999:
            continue
        raised = m[0][0] in SUPERSCRIPTS or any(a <= start and end <= b for a, b in superscripts)
        if raised:
            out.append((start, end, value, "superscript", 3.0))
            continue
        if _PINPOINT.search(before.rstrip()) or _PROVISION.search(before) or _UNITS.match(after) or _DAY_BEFORE.search(before) or _DAY_AFTER.match(after) or _YEAR.match(after):
            continue
        if re.search(r"[a-z][.,;:\"”’)\]]?$", before) and (not after or after[0].isspace() or after[0] in ".,;:)"):
            out.append((start, end, value, "tight", 1.5))
        elif re.search(r"[.,;:\"”’)\]]\s$", before) and not after.strip():
            out.append((start, end, value, "spaced_eol", 0.75))
        elif before.endswith("(") and after.startswith(")"):
            out.append((start - 1, end + 1, value, "paren", 0.5))
    return out


def reference_rows(lines: DataFrame) -> DataFrame:
    """Reference candidates of body lines: doc_id, page_index, line_id, start, end, value, form, score."""
    kinds = {c: lines.schema[c].dataType.simpleString() for c in ("doc_id", "page_index")}
    raised = F.transform(F.filter("spans", lambda s: s["superscript"]), lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))) if "spans" in lines.columns else F.array().cast("array<struct<a:int,b:int>>")

    def rows(batches):
        for batch in batches:
            at, out = [], []
            for k, (t, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("raised").to_pylist())):
                for c in reference_candidates(t, [(s["a"], s["b"]) for s in spans or []]):
                    at.append(k)
                    out.append(c)
            index = pa.array(at, pa.int64())
            cols = list(zip(*out)) or [[]] * 5
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in ("doc_id", "page_index", "line_id")), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "page_index", "line_id", "start", "end", "value", "form", "score"])

    asked = lines.where((S.zone(F.col("region_type")) == "body") & F.col("text").rlike(f"[0-9{SUPERSCRIPTS}]"))
    return asked.select("doc_id", "page_index", "line_id", "text", raised.alias("raised")).mapInArrow(rows, f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, line_id string, start int, end int, value int, form string, score double")


def label_rows(lines: DataFrame) -> DataFrame:
    """Label candidates of note lines: doc_id, page_index, line_id, label, value, form (plain, paren, bracket, alone), score."""
    text = F.col("text")
    form = F.when(text.rlike(r"^\s*\([0-9]{1,4}\)|^\s*[0-9]{1,4}\)"), "paren").when(text.rlike(r"^\s*\[[0-9]{1,4}\]"), "bracket").when(S.is_shape("note_label_alone", text), "alone").when(T.label_prefix(text).isNotNull(), "plain")
    label = F.coalesce(T.label_prefix(text), F.regexp_extract(text, r"^\s*[(\[]?([0-9]{1,4})[)\]]", 1))
    score = F.when(S.zone(F.col("region_type")) == "note", 2.0).otherwise(0.5) - F.when(S.is_shape("volume_citation", F.trim(text)) | S.is_shape("bracketed_year", F.trim(text)), 1.5).otherwise(0.0)
    rows = lines.select("doc_id", "page_index", "line_id", label.alias("label"), F.when(label.rlike("^[0-9]{1,4}$"), label.cast("int")).alias("value"), form.alias("form"), score.alias("score"))
    return rows.where("form is not null")


def label_style(labels: DataFrame) -> DataFrame:
    """Whether a document's labels stand in brackets: three or more, and more than twice the plain ones."""
    told = labels.groupBy("doc_id").agg(F.count_if(F.col("form") == "paren").alias("paren"), F.count_if(F.col("form").isin("plain", "alone")).alias("plain"))
    return told.withColumn("in_brackets", (F.col("paren") >= PAREN_LABELS) & (F.col("paren") > 2 * F.col("plain")))


def endnote_chains(chains: DataFrame, pages: DataFrame) -> DataFrame:
    """Chains of labels (doc_id, chain, page_index) that stand in the last quarter of a document."""
    top = pages.groupBy("doc_id").agg(F.max("page_index").alias("last"))
    told = chains.join(top, "doc_id").groupBy("doc_id", "chain").agg(F.count("*").alias("labels"), F.max("last").alias("last"), F.count_if(F.col("page_index") > ENDNOTE_TAIL * F.col("last")).alias("late"))
    return told.withColumn("endnotes", (F.col("labels") >= ENDNOTE_LABELS) & (F.col("last") > 1) & (F.col("late") / F.col("labels") >= ENDNOTE_SHARE))


def merge_detached(pairs: DataFrame, detached: DataFrame) -> DataFrame:
    """The pair of each detached mark: same note id, at most a page away or an endnote, nearest, label after the mark first.

    pairs: doc_id, pair_id, note_id, page_index, place, endnote; detached: doc_id, mark_id, note_id,
    page_index, place.
    """
    label = pairs.select("doc_id", "note_id", "pair_id", F.col("page_index").alias("label_page"), F.col("place").alias("label_place"), "endnote")
    met = detached.join(label, ["doc_id", "note_id"]).withColumn("away", F.abs(F.col("label_page") - F.col("page_index")))
    rank = F.struct("away", F.col("label_place") < F.col("place"), F.abs(F.col("label_place") - F.col("place")), F.col("pair_id"))
    return met.where((F.col("away") <= 1) | F.col("endnote")).groupBy("doc_id", "mark_id").agg(F.min_by("pair_id", rank).alias("pair_id"))


def note_bodies(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Text of each note: its lines from its label to the next label of the document, without blank lines.

    lines: doc_id, page_index, reading_order, line_id, text, region_type; labels: doc_id, line_id, label.
    Only note lines are read; a note goes on over pages as long as note lines do.
    """
    order = Window.partitionBy("doc_id").orderBy("page_index", "reading_order", "line_id")
    own = lines.where(S.zone(F.col("region_type")) == "note").join(labels.select("doc_id", "line_id", "label"), ["doc_id", "line_id"], "left")
    numbered = own.withColumn("note_no", F.count("label").over(order)).where("note_no > 0")
    listed = numbered.groupBy("doc_id", "note_no").agg(F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct("page_index", "reading_order", "line_id", "text"))).alias("ls"))
    return listed.select("doc_id", "note_no", "label", T.joined_lines(F.transform("ls", lambda x: x["text"])).alias("body"), F.array_distinct(F.transform("ls", lambda x: x["page_index"])).alias("body_pages"), F.transform("ls", lambda x: x["line_id"]).alias("line_ids"))


def flows_on(previous: Column, current: Column) -> Column:
    """A line goes on in the next: a word broken by a hyphen, a sentence in lower case, or an open bracket."""
    before, now = F.trim(previous), F.trim(current)
    word = S.is_shape("hyphen_tail", before) & S.is_shape("hyphen_head", now)
    sentence = ~S.is_shape("sentence_ended", before) & now.rlike(r"^\p{Ll}")
    bracket = (S.bracket_excess(before) > 0) & S.closes_before_opening(now)
    return F.coalesce((before != "") & (now != "") & (word | (~S.is_shape("list_opener", now) & (sentence | bracket))), F.lit(False))


def flow_edges(lines: DataFrame) -> DataFrame:
    """Body lines with whether they continue the line before and go on in the line after."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("reading_order", "line_id")
    body = lambda c: c == "body"
    seen = lines.select("doc_id", "page_index", "line_id", "text", "region_type", F.lag("text").over(order).alias("p"), F.lag("region_type").over(order).alias("pr"), F.lead("text").over(order).alias("n"), F.lead("region_type").over(order).alias("nr"))
    return seen.select("doc_id", "page_index", "line_id", (F.coalesce(body(F.col("pr")), F.lit(False)) & flows_on(F.col("p"), F.col("text"))).alias("continues"), (F.coalesce(body(F.col("nr")), F.lit(False)) & flows_on(F.col("text"), F.col("n"))).alias("goes_on"))


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Enumerated lines for the outline: with their title on the line, or alone with the next line as title.

    doc_id, seq, page_index, line_id, value, punct, title, joined_line_id, plausible.
    """
    order = Window.partitionBy("doc_id", "page_index").orderBy("reading_order", "line_id")
    inline, alone = S.PATTERNS["inline_enumerator"], S.PATTERNS["standalone_enumerator"]
    seen = lines.select("doc_id", "page_index", "reading_order", "line_id", "text", F.lead("text").over(order).alias("next_text"), F.lead("line_id").over(order).alias("next_id"))
    single = F.col("text").rlike(alone)
    part = lambda k: F.when(single, F.regexp_extract("text", alone, k)).otherwise(F.regexp_extract("text", inline, k))
    title = F.when(single, F.trim("next_text")).otherwise(F.regexp_extract("text", inline, 3))
    rows = seen.where(single | F.col("text").rlike(inline)).select("doc_id", (F.col("page_index").cast("bigint") * 100_000 + F.col("reading_order")).alias("seq"), "page_index", "line_id", part(1).alias("value"), part(2).alias("punct"), title.alias("title"), F.when(single, F.col("next_id")).alias("joined_line_id"))
    return rows.withColumn("plausible", F.coalesce(title_plausible(F.col("title")), F.lit(False)))


def title_plausible(title: Column) -> Column:
    """Short, capitalised, no sentence and no citation."""
    words = F.size(F.split(F.trim(title), r"\s+"))
    cited = S.is_shape("volume_citation", title) | title.rlike(r"\[(?:1[5-9]|20)\d\d\]|\b(?:supra|ibid|infra)\b|\bv\.\s")
    return (words <= 14) & title.rlike(r"^\P{L}*\p{Lu}") & ~title.rlike(r"[,;:]\s*$") & ~S.is_shape("sentence_ended", title) & ~cited & ((S.capitalised_share(title) >= 0.6) | S.all_caps(title))


def contents_rows(lines: DataFrame) -> DataFrame:
    """Lines of contents lists: the heading and entries with leaders, with up to six text lines wrapped between entries."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("reading_order", "line_id")
    text = F.col("text")
    body = lines.where(~F.coalesce(F.col("region_type").isin("header", "footer"), F.lit(False)))
    entry = S.is_shape("contents_leader", text) & text.rlike(r"\p{L}") & text.rlike(r"[0-9]\s*$")
    head = F.lower(F.trim(text)).isin(*CONTENTS_HEADINGS)
    locator = text.rlike(r"^[0-9.\s]*[0-9][0-9.\s]*$")
    seen = body.select("doc_id", "page_index", "reading_order", "line_id", entry.alias("entry"), head.alias("head"), (~entry & ~head & ~locator).cast("int").alias("prose"))
    # A run of more than six text lines, or a heading after it, parts one list from the next.
    counted = seen.withColumn("upto", F.sum("prose").over(order))
    last = F.last(F.when(F.col("entry") | F.col("head"), F.col("upto")), True)
    gap = F.col("upto") - last.over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = counted.withColumn("new", ((F.col("entry") | F.col("head")) & F.coalesce(gap > CONTENTS_WRAPPED, F.lit(True))).cast("int")).withColumn("list_no", F.sum("new").over(order)).where("list_no > 0")
    keys = Window.partitionBy("doc_id", "page_index", "list_no")
    placed = marked.withColumns({"entries": F.count_if("entry").over(keys), "end": F.max(F.when(F.col("entry") | F.col("head"), F.struct("reading_order", "line_id"))).over(keys)})
    return placed.where((F.col("entries") >= CONTENTS_ENTRIES) & (F.struct("reading_order", "line_id") <= F.col("end"))).select("doc_id", "page_index", "line_id", "list_no", "entries")


def sandwiched(regions: DataFrame) -> DataFrame:
    """Region labels after the rules for notes: what stands between notes low on a page is a note, notes at the top are text.

    regions: doc_id, page_index, region_id, label, bbox, page_width, page_height.
    """
    column = (G.center_x(F.col("bbox")) >= F.col("page_width") / 2).cast("int")
    ratio = G.center_y(F.col("bbox")) / F.col("page_height")
    note = F.col("label").isin(*S.NOTE_REGIONS)
    rows = regions.withColumns({"column_no": column, "ratio": ratio, "note": note})
    order = Window.partitionBy("doc_id", "page_index", "column_no", "low").orderBy("bbox.y0", "bbox.x0", "region_id")
    ranked = rows.withColumn("low", F.col("ratio") >= SANDWICH_BAND)
    two = F.col("note") & F.lag("note").over(order)
    seen = ranked.withColumn("two", F.coalesce(two, F.lit(False)).cast("int")).withColumns({"opened": F.max("two").over(order.rowsBetween(Window.unboundedPreceding, -1)), "later": F.max(F.col("note").cast("int")).over(order.rowsBetween(1, Window.unboundedFollowing))})
    between = F.col("low") & ~F.col("note") & (F.coalesce("opened", F.lit(0)) == 1) & (F.coalesce("later", F.lit(0)) == 1)
    free = ~F.col("label").isin(*S.VISUAL_REGIONS, *S.PAGE_NUMBER_REGIONS)
    label = F.when(F.col("note") & (F.col("ratio") <= TOP_BAND), "text").when(between & free, "footnote").otherwise(F.col("label"))
    return seen.select("doc_id", "page_index", "region_id", label.alias("label"))


def order_decisions(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """For each page whether its source order stays: kind, switches before and after, and the decision with its reason."""
    page = ["doc_id", "page_index"]
    models = layout.column_models(lines, pages)
    source = lines.join(models.select(*page, "split_x", "kind"), page, "left").withColumn("column_no", F.coalesce((G.center_x(F.col("bbox")) >= F.col("split_x")).cast("int"), F.lit(0)))
    challenger = layout.column_order(lines, models.where("kind = 'two_column'")).withColumnRenamed("reading_order", "new_order")
    moved = source.join(challenger, [*page, "line_id"])
    was = layout.order_scores(source).select(*page, "switches", (F.col("hyphens") - F.col("closed")).alias("broken"), "closed")
    now = layout.order_scores(moved.withColumn("reading_order", F.col("new_order"))).select(*page, F.col("switches").alias("new_switches"), (F.col("hyphens") - F.col("closed")).alias("new_broken"), F.col("closed").alias("new_closed"))
    runs = layout.column_runs(source)
    size = lines.groupBy(*page).agg(F.count("*").alias("n"), F.count_if(G.is_valid(F.col("bbox"))).alias("boxed"), F.bool_or(S.is_shape("table_caption", F.col("text"))).alias("table"))
    met = size.join(was, page).join(now, page).join(runs, page).join(models.select(*page, "kind"), page, "left")
    two = F.col("kind") == "two_column"
    repaired = two & (F.col("switches") >= COLUMN_SWITCHES) & (F.col("median_run") <= LONG_RUN) & (F.col("new_switches") <= 2) & (F.col("switches") - F.col("new_switches") >= 2) & (F.col("new_closed") >= F.col("closed")) & (F.col("new_broken") <= F.col("broken"))
    reason = F.when((F.col("n") < ORDER_LINES) | (F.col("boxed") * 5 < F.col("n") * 4), "insufficient_geometry").when(F.col("table"), "table_grid").when(repaired, "column_interleave_repair").when(two, "two_column_coherent").when(F.col("kind").isNull(), "single_column").otherwise("non_two_column")
    return met.select(*page, F.coalesce("kind", F.lit("single")).alias("kind"), "switches", "new_switches", (reason == "column_interleave_repair").alias("repair"), reason.alias("reason"))


def protected_spans(text: str, reporters: tuple[str, ...]) -> list[tuple[int, int]]:
    """Character spans of case citations: year or volume, one of the reporters, page."""
    names = "|".join(re.escape(r) for r in sorted(reporters, key=len, reverse=True))
    pattern = re.compile(rf"(?:\[\d{{4}}\]\s*|\(\d{{4}}\),?\s*|\b\d{{4}}\s+)?(?:\d{{1,4}}\s+)?(?:{names})(?:\s*\(\d[a-z]{{1,2}}\))?\s+\d{{1,5}}\b")
    return [m.span() for m in pattern.finditer(text)] if names else []


def runs(text: Column) -> Column:
    """Runs of digits, raised digits and note symbols of a text: structs kind, start, end, value, in order.

    Digit runs of more than seven are passed over; raised ones are cut after four, symbols after eight.
    """
    digit, raised, symbol = "[0-9]", f"[{SUPERSCRIPTS}]", f"[{T.NOTE_SYMBOLS}]"
    same = "|".join(f"(?<={c})(?!{c})|(?<!{c})(?={c})" for c in (digit, raised, symbol))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        kind = F.when(piece.rlike(f"^{digit}"), "digits").when(piece.rlike(f"^{raised}"), "raised").when(piece.rlike(f"^{symbol}"), "symbols")
        size = F.when(kind == "digits", F.lit(LONGEST_DIGITS)).when(kind == "raised", F.lit(LONGEST_RAISED)).otherwise(F.lit(LONGEST_SYMBOLS))
        begins = F.when(kind.isNotNull() & ~((kind == "digits") & (F.length(piece) > LONGEST_DIGITS)), F.sequence(F.lit(0), F.length(piece) - 1, size)).otherwise(F.array().cast("array<int>"))
        made = F.transform(begins, lambda b: F.struct(kind.alias("kind"), (acc["at"] + b).alias("start"), (acc["at"] + F.least(b + size, F.length(piece))).alias("end"), F.substring(piece, b + 1, size).alias("value")))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.concat(acc["out"], made).alias("out"))

    return F.aggregate(F.filter(F.split(text, same), lambda p: p != ""), start, step, lambda acc: acc["out"])


def observed_marker(value: Column) -> Column:
    """A marker as seen: digits and symbols in their plain form, without white space, brackets and closing stops."""
    plain = F.translate(F.translate(F.regexp_replace(value, r"\s+", ""), *T.CANONICAL_SYMBOLS), "⁰¹²³⁴⁵⁶⁷⁸⁹０１２３４５６７８９", "01234567890123456789")
    return F.regexp_replace(F.regexp_replace(plain, r"[.):\]]+$", ""), r"^[(\[]+", "")


def marker_confidence(value: Column) -> Column:
    return F.bround(value, 3)


def kept_labels(labels: DataFrame) -> DataFrame:
    """Labels of a chain that stay without a reference: in a note zone, with a fair score or a neighbour one value away.

    labels: doc_id, chain, place, label_id, value, page_index, zone, score. A neighbour counts on the same or the
    next page.
    """
    order = Window.partitionBy("doc_id", "chain").orderBy("place", "label_id")

    def beside(move) -> Column:
        return F.coalesce((F.abs(F.col("value") - move("value").over(order)) == 1) & (F.abs(F.col("page_index") - move("page_index").over(order)) <= 1), F.lit(False))

    seen = labels.withColumn("beside", beside(F.lag) | beside(F.lead))
    return seen.where((F.col("zone") == "note") & ((F.col("score") >= NOTE_SCORE) | F.col("beside"))).select("doc_id", "chain", "label_id", "value")


def observations(evidence: DataFrame) -> DataFrame:
    """The observations of each candidate in order, each once: doc_id, candidate_id, observations.

    evidence: doc_id, candidate_id, seq, kind, source, value; one that is equal to an earlier one is passed over.
    """
    first = evidence.groupBy("doc_id", "candidate_id", "kind", "source", "value").agg(F.min("seq").alias("seq"))
    listed = first.groupBy("doc_id", "candidate_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "source", "value"))).alias("ls"))
    return listed.select("doc_id", "candidate_id", F.transform("ls", lambda x: F.struct(x["kind"].alias("kind"), x["source"].alias("source"), x["value"].alias("value"))).alias("observations"))


def marker_audit(pairs: DataFrame, references: DataFrame) -> DataFrame:
    """A row for each marker of the notes of a document: its role, status, observed form and confidence.

    pairs: doc_id, pair_id, label_id, label_text, label_score, ref_id (null where none was found), ref_score;
    references: doc_id, ref_id, text, score. Roles are label and reference; a label is paired or label_only, a
    reference paired or unpaired.
    """
    told = lambda df, role, status, marker, pair, text, score: df.select("doc_id", F.lit(role).alias("role"), status.alias("status"), marker.cast("string").alias("marker_id"), pair.alias("pair_id"), observed_marker(text).alias("observed"), marker_confidence(score).alias("confidence"))
    status = F.when(F.col("ref_id").isNull(), "label_only").otherwise("paired")
    rows = told(pairs, "label", status, F.col("label_id"), F.col("pair_id"), F.col("label_text"), F.col("label_score"))
    met = references.join(pairs.where("ref_id is not null").select("doc_id", "ref_id", "pair_id"), ["doc_id", "ref_id"], "left")
    return rows.unionByName(told(met, "reference", F.when(F.col("pair_id").isNull(), "unpaired").otherwise("paired"), F.col("ref_id"), F.col("pair_id"), F.col("text"), F.col("score")))


def audit_counts(audit: DataFrame) -> DataFrame:
    """Markers of each role and status of a document."""
    return audit.groupBy("doc_id", "role", "status").agg(F.count("*").alias("n"))
