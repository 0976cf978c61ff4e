"""The registered queries over the library's own operators, each with its SQL twin where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import eids, geometry, locators, patterns, shapes, stats
from lexweave.functions import text as T
from lexweave.operators import candidates, citations, corpus, furniture, ladder, layout, lookup, marks, notes, regions, statute
from lexweave.operators import export as X
from lexweave.operators import lines as L
from lexweave.operators.amendments import amendment
from lexweave.plans.catalog import register
from lexweave.plans.synthetic import EXAMPLE_LINES, LINES, STATUTES, lines, pages, read
from lexweave.sources import files

# --- Shapes of lines: a row for each line that has the shape ------------------------------------------

RE2_SHAPES = tuple(n for n in shapes.PATTERNS if n not in ("date_line", "crossref", "note_marker"))


def _shape(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return EXAMPLE_LINES.frame(spark, sf_dir).where(shapes.is_shape(name, F.col("text"))).select("doc_id", "line_id", "text")

    pattern = shapes.PATTERNS[name].replace("'", "''")
    register(f"shape_{name}", EXAMPLE_LINES.over(f"SELECT doc_id, line_id, text FROM t WHERE regexp_matches(text, '{pattern}')"))(query)


for _name in RE2_SHAPES:
    _shape(_name)


@register("shape_date_line", EXAMPLE_LINES.over(f"SELECT doc_id, line_id FROM t WHERE regexp_matches(text, '{shapes.PATTERNS['date_line'].replace('(?iu)', '(?i)')}')"))
def shape_date_line(spark, sf_dir):
    return EXAMPLE_LINES.frame(spark, sf_dir).where(shapes.is_shape("date_line", F.col("text"))).select("doc_id", "line_id")


@register("printed_folio_numbers", EXAMPLE_LINES.over("SELECT doc_id, line_id, CAST(regexp_extract(text, '^\\s*-?\\s*(\\d{1,4})\\s*-?\\s*$', 1) AS INTEGER) AS folio FROM t WHERE regexp_matches(text, '^\\s*-?\\s*\\d{1,4}\\s*-?\\s*$')"))
def printed_folio_numbers(spark, sf_dir):
    return EXAMPLE_LINES.frame(spark, sf_dir).select("doc_id", "line_id", shapes.arabic_page_number(F.col("text")).alias("folio")).where("folio is not null")


@register(
    "letter_case_measures",
    EXAMPLE_LINES.over(
        """, m AS (SELECT doc_id, line_id, regexp_replace(text, '[^\\p{L}]', '', 'g') AS own, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: regexp_matches(w, '\\p{L}')) AS words FROM t)
        SELECT doc_id, line_id, own <> '' AND own = upper(own) AS caps,
               CASE WHEN own <> '' THEN round(length(regexp_replace(own, '[^\\p{Lu}]', '', 'g')) / length(own), 6) ELSE 0 END AS upper_share,
               CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda w: regexp_matches(w, '^\\p{Lu}'))) / len(words), 6) ELSE 0 END AS title_share FROM m"""
    ),
)
def letter_case_measures(spark, sf_dir):
    t = F.col("text")
    return EXAMPLE_LINES.frame(spark, sf_dir).select("doc_id", "line_id", shapes.all_caps(t).alias("caps"), F.round(shapes.upper_share(t), 6).alias("upper_share"), F.round(shapes.capitalised_share(t), 6).alias("title_share"))


@register("bracket_excess", EXAMPLE_LINES.over("SELECT doc_id, line_id, CAST(CASE WHEN contains(text, '(bracket') THEN 1 ELSE 0 END AS INTEGER) AS excess FROM t"))
def bracket_excess(spark, sf_dir):
    return EXAMPLE_LINES.frame(spark, sf_dir).select("doc_id", "line_id", shapes.bracket_excess(F.col("text")).alias("excess"))


@register("title_runs_on", EXAMPLE_LINES.over("SELECT doc_id, line_id FROM t WHERE text IN ('Levy, and', 'Levy for the', 'an open (bracket', 'exam-', '- 7 -', 'It goes on') OR text LIKE '%(bracket'"))
def title_runs_on(spark, sf_dir):
    return EXAMPLE_LINES.frame(spark, sf_dir).where(shapes.title_runs_on(F.col("text"))).select("doc_id", "line_id")


@register("note_label_prefixes", EXAMPLE_LINES.over("SELECT doc_id, line_id, CASE WHEN text = '*' THEN '∗' WHEN text LIKE '*%' THEN '*' ELSE regexp_extract(text, '^\\s*([0-9]{1,4})(?:[\\s.)\\],:;-])', 1) END AS label FROM t WHERE text = '*' OR regexp_matches(text, '^\\s*[0-9]{1,4}(?:\\s|[.)\\],:;-](?:\\s|$))')").replace("CASE WHEN text = '*' THEN '∗' WHEN text LIKE '*%' THEN '*'", "CASE WHEN text = '*' THEN '*'"))
def note_label_prefixes(spark, sf_dir):
    return EXAMPLE_LINES.frame(spark, sf_dir).select("doc_id", "line_id", T.label_prefix(F.col("text")).alias("label")).where("label is not null")


@register("repeat_text_keys", EXAMPLE_LINES.over("SELECT doc_id, line_id, CASE WHEN length(array_to_string(regexp_extract_all(lower(text), '[a-z]+'), '')) < 6 THEN '' ELSE array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') END AS key FROM t"))
def repeat_text_keys(spark, sf_dir):
    return EXAMPLE_LINES.frame(spark, sf_dir).select("doc_id", "line_id", shapes.repeat_text_key(F.col("text")).alias("key"))


# --- Statutes ------------------------------------------------------------------------------------------


def _parsed(spark, sf_dir, *parts, cite=True):
    rows = STATUTES.frame(spark, sf_dir).select("doc_id", "seq", "text", F.lit(1).alias("page_number"), F.lit("unknown").alias("note_class"))
    return statute.parse(rows, cite=cite, parts=parts)


def _resolved(spark, sf_dir):
    return statute.citations(_parsed(spark, sf_dir))


STATUTE_CITES = """, n AS (SELECT doc_id, max(seq) AS top FROM t GROUP BY doc_id),
c AS (SELECT t.doc_id, 'sec_' || seq || '__subsec_1' AS parent_eid,
  CASE kind WHEN 0 THEN 'sec_' || target || '__subsec_1' WHEN 1 THEN 'sec_' || target || '__subsec_1' WHEN 2 THEN 'rule_' || target || '__subrule_4' ELSE 'sec_' || target END AS target_eid,
  CASE kind WHEN 0 THEN 'notwithstanding' WHEN 1 THEN 'subject_to' ELSE 'reference' END AS relation,
  kind >= 2 AS external, kind < 2 AND target <= top AS resolved FROM t JOIN n USING (doc_id)) """


@register("statute_citation_summary", STATUTES.over(STATUTE_CITES + "SELECT relation, resolved, external, count(*) AS citations FROM c GROUP BY ALL"))
def statute_citation_summary(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("relation", "resolved", "external").agg(F.count("*").alias("citations"))


@register("statute_citations", STATUTES.over(STATUTE_CITES + "SELECT doc_id, parent_eid, target_eid, relation, resolved, external FROM c"))
def statute_citations(spark, sf_dir):
    return _resolved(spark, sf_dir).select("doc_id", "parent_eid", "target_eid", "relation", "resolved", "external")


@register("joined_resolution", STATUTES.over(STATUTE_CITES + "SELECT doc_id, parent_eid, target_eid, resolved FROM c"))
def joined_resolution(spark, sf_dir):
    """Citations found on flat provisions and resolved by a join, for documents of any size."""
    rows = STATUTES.frame(spark, sf_dir).select("doc_id", "seq", "text", F.lit(1).alias("page_number"), F.lit("unknown").alias("note_class"))
    provisions = statute.provisions(statute.parse(rows))
    return citations.resolve(citations.extract_citations(provisions), provisions).select("doc_id", "parent_eid", "target_eid", "resolved")


@register("citation_spans", STATUTES.over("""SELECT doc_id, 'sec_' || seq || '__subsec_1' AS parent_eid, CAST(length(CASE kind WHEN 0 THEN 'Notwithstanding anything in ' WHEN 1 THEN 'Subject to ' WHEN 2 THEN 'As provided in ' ELSE 'Under ' END) AS INTEGER) AS span_start,
  CASE kind WHEN 0 THEN 'sub-section (1) of section ' || target WHEN 1 THEN 'section ' || target || '(1)' WHEN 2 THEN 'rule ' || target || '(4)' ELSE 'section ' || target || ' of the Central Excise Act, 1944' END AS raw_text FROM t"""))
def citation_spans(spark, sf_dir):
    return _resolved(spark, sf_dir).select("doc_id", "parent_eid", "span_start", "raw_text")


@register("unresolved_citations", STATUTES.over(STATUTE_CITES + "SELECT doc_id, parent_eid, target_eid FROM c WHERE NOT resolved AND NOT external"))
def unresolved_citations(spark, sf_dir):
    return _resolved(spark, sf_dir).where("not resolved and not external").select("doc_id", "parent_eid", "target_eid")


@register("statute_provisions", STATUTES.over("SELECT doc_id, 'sec_' || seq AS eid, 'section' AS kind, CAST(NULL AS VARCHAR) AS parent_eid, CAST(0 AS INTEGER) AS depth, regexp_extract(text, '^[0-9]+\\. (.*)\\.—', 1) AS heading, '' AS text FROM t UNION ALL SELECT doc_id, 'sec_' || seq || '__subsec_1', 'subsection', 'sec_' || seq, 1, NULL, regexp_extract(text, '—\\(1\\) (.*)$', 1) FROM t"))
def statute_provisions(spark, sf_dir):
    return statute.provisions(_parsed(spark, sf_dir, "provisions", cite=False)).select("doc_id", "eid", "kind", "parent_eid", "depth", "heading", "text")


@register("statute_summary", STATUTES.over(STATUTE_CITES + "SELECT doc_id, CAST(2 * (SELECT top FROM n WHERE n.doc_id = c.doc_id) AS BIGINT) AS provisions, count(*) AS citations, count(*) FILTER (resolved) AS resolved, count(*) FILTER (external) AS external, count(*) FILTER (NOT resolved AND NOT external) AS unresolved FROM c GROUP BY doc_id"))
def statute_summary(spark, sf_dir):
    """Counts on each document's own row: no join and one pass."""
    size = lambda cond: F.size(F.filter("citations", cond)).cast("bigint")
    return _parsed(spark, sf_dir, "provisions").select("doc_id", F.size("provisions").cast("bigint").alias("provisions"), F.size("citations").cast("bigint").alias("citations"), size(lambda c: c["resolved"]).alias("resolved"), size(lambda c: c["external"]).alias("external"), size(lambda c: ~c["resolved"] & ~c["external"]).alias("unresolved"))


@register("document_summary", STATUTES.over(STATUTE_CITES + "SELECT doc_id, CAST(2 * (SELECT top FROM n WHERE n.doc_id = c.doc_id) AS BIGINT) AS provisions, count(*) FILTER (resolved) AS resolved FROM c GROUP BY doc_id"))
def document_summary(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, "provisions")
    return X.summary(statute.provisions(parsed), statute.citations(parsed)).select("doc_id", "provisions", "resolved")


@register("statute_diagnostics", LINES.over("SELECT DISTINCT doc_id, 'statute.preamble_recovered' AS code, 1 AS n FROM t"))
def statute_diagnostics(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).select("doc_id", (F.col("page_index") * 10 + F.col("reading_order")).alias("seq"), "text", "page_number", F.lit("unknown").alias("note_class"))
    return statute.diagnostics(statute.parse(rows)).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@register("statute_json")
def statute_json(spark, sf_dir):
    """Each document's tree on its own row: the lines are sorted and parsed once, and nothing is joined."""
    return X.document_json(_parsed(spark, sf_dir, "provisions", cite=False))


@register("section_openers", STATUTES.over("SELECT doc_id, seq, regexp_extract(text, '^([0-9]{1,3}[A-Za-z]*)\\.', 1) AS num FROM t"))
def section_openers(spark, sf_dir):
    p = patterns.SECTION
    return STATUTES.frame(spark, sf_dir).where(F.col("text").rlike(p)).select("doc_id", "seq", F.regexp_extract("text", p, 2).alias("num"))


@register(
    "provision_window_twin",
    STATUTES.over("SELECT doc_id, seq, 'sec_' || seq AS section_eid, CAST(seq AS BIGINT) AS node_id FROM t"),
)
def provision_window_twin(spark, sf_dir):
    """The open section of every line by windows alone: the last opener, and a running count of openers."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = STATUTES.frame(spark, sf_dir)
    opens = F.col("text").rlike(patterns.SECTION)
    eid = F.when(opens, eids.section(F.regexp_extract("text", patterns.SECTION, 2)))
    return rows.select("doc_id", "seq", F.last(eid, True).over(order).alias("section_eid"), F.sum(opens.cast("bigint")).over(order).alias("node_id"))


AMENDMENT_TEXT = "concat(l_linenumber, '. ', CASE l_partkey % 4 WHEN 0 THEN 'Subs.' WHEN 1 THEN 'Ins.' WHEN 2 THEN 'Omitted' ELSE 'See' END, ' by Act ', l_suppkey % 50 + 1, ' of 2019, s. ', l_partkey % 200, ' (w.e.f. 1-', l_linenumber, '-2020)')"


@register(
    "amendment_notes",
    f"WITH t AS (SELECT l_partkey, l_suppkey, l_linenumber, {AMENDMENT_TEXT} AS text FROM lineitem) SELECT text, CASE l_partkey % 4 WHEN 0 THEN 'substituted' WHEN 1 THEN 'inserted' ELSE 'omitted' END AS action, 'Act ' || (l_suppkey % 50 + 1) || ' of 2019' AS act, 's. ' || (l_partkey % 200) AS section, '1-' || l_linenumber || '-2020' AS effective, CAST(l_linenumber AS VARCHAR) AS number FROM t WHERE l_partkey % 4 < 3",
)
def amendment_notes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr(f"{AMENDMENT_TEXT} AS text").select("text", amendment(F.col("text")).alias("a")).where("a is not null")
    return rows.select("text", "a.action", F.col("a.amending_act").alias("act"), F.col("a.amending_section").alias("section"), F.col("a.effective_date").alias("effective"), F.col("a.footnote_number").alias("number"))


@register("eid_paths", "SELECT l_orderkey, concat('sec_', l_partkey % 90) || CASE WHEN l_linenumber % 2 = 0 THEN '__subsec_' || l_linenumber ELSE '' END || CASE WHEN l_suppkey % 3 = 0 THEN '__cl_b' ELSE '' END AS eid, count(*) AS n FROM lineitem GROUP BY ALL")
def eid_paths(spark, sf_dir):
    made = eids.provision((F.col("l_partkey") % 90).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")), F.when(F.col("l_suppkey") % 3 == 0, F.lit("B")), F.lit(None).cast("string"))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", made.alias("eid")).agg(F.count("*").alias("n"))


@register("eid_deduplication", LINES.over("SELECT doc_id, line_id, base || CASE WHEN n > 1 THEN '__dup' || n ELSE '' END AS eid FROM (SELECT doc_id, line_id, 'sec_' || (k % 9) AS base, row_number() OVER (PARTITION BY doc_id, k % 9 ORDER BY line_id) AS n FROM t)"))
def eid_deduplication(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).withColumn("base", eids.section((F.col("k") % 9).cast("string")))
    return rows.select("doc_id", "line_id", eids.deduplicated(F.col("base"), ["line_id"]).alias("eid"))


@register("clause_labels", "SELECT DISTINCT CAST(l_partkey % 60 AS INTEGER) AS ordinal, CASE WHEN l_partkey % 60 < 26 THEN chr(CAST(97 + l_partkey % 60 AS INTEGER)) ELSE chr(CAST(97 + floor((l_partkey % 60 - 26) / 26) AS INTEGER)) || chr(CAST(97 + (l_partkey % 60 - 26) % 26 AS INTEGER)) END AS label FROM lineitem")
def clause_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).cast("int").alias("ordinal")).distinct()
    return rows.select("ordinal", eids.expected_clause_label(F.col("ordinal")).alias("label"))


@register("schedule_ordinals", "SELECT DISTINCT w, CAST(coalesce(v, -1) AS INTEGER) AS ordinal FROM (SELECT CASE l_partkey % 5 WHEN 0 THEN 'IV' WHEN 1 THEN 'second' WHEN 2 THEN '7.' WHEN 3 THEN 'Z' ELSE 'NINTH' END AS w, CASE l_partkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 7 WHEN 3 THEN NULL ELSE 9 END AS v FROM lineitem)")
def schedule_ordinals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("CASE l_partkey % 5 WHEN 0 THEN 'IV' WHEN 1 THEN 'second' WHEN 2 THEN '7.' WHEN 3 THEN 'Z' ELSE 'NINTH' END AS w").distinct()
    return rows.select("w", F.coalesce(shapes.schedule_ordinal(F.col("w")), F.lit(-1)).alias("ordinal"))


# --- Texts, lines, glyphs ------------------------------------------------------------------------------


@register("split_lines", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, trim(l, ' ') AS text FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS l, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i FROM documents) WHERE trim(l, ' ') <> ''")
def split_lines(spark, sf_dir):
    return L.text_lines(read(spark, sf_dir, "documents")).select("doc_id", "seq", "text")


@register("broken_font_gate", "SELECT doc_id, CAST(length(regexp_replace(text, '[^e]', '', 'g')) AS BIGINT) AS bars, length(regexp_replace(text, '[^e]', '', 'g')) >= 8 AND FALSE AS broken FROM documents".replace("[^e]", "[^―]"))
def broken_font_gate(spark, sf_dir):
    return L.broken_font(read(spark, sf_dir, "documents")).select("doc_id", "bars", "broken")


@register("quotation_repair", LINES.over("SELECT doc_id, line_id, CASE WHEN k % 2 = 0 THEN '“' ELSE '―' END || text || '”' AS text FROM t"))
def quotation_repair(spark, sf_dir):
    return LINES.frame(spark, sf_dir).select("doc_id", "line_id", L.repaired(F.concat(F.lit("―"), F.col("text"), F.lit("‖")), F.col("k") % 2 == 0).alias("text"))


@register("text_quality", "SELECT doc_id, round_even(greatest(least(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) / 100.0, 1.0) * (len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}\\p{P}\\p{S} ]')) / greatest(length(text), 1)) * (1 - least((len(regexp_extract_all(text, '\\x{FFFD}')) / greatest(length(text), 1)) * 20, 1.0)), 0.0), 4) AS quality FROM documents")
def text_quality(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.text_quality(F.split("text", "\n")).alias("quality"))


@register("furniture_keys", LINES.over("SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key, count(DISTINCT page_index) AS pages FROM t GROUP BY ALL HAVING count(DISTINCT page_index) >= 4"))
def furniture_keys(spark, sf_dir):
    return L.edge_furniture(lines(spark, sf_dir), pages(spark, sf_dir)).select("doc_id", "key", "pages")


@register(
    "statute_line_stream",
    LINES.over(
        """, heads AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key FROM t GROUP BY ALL HAVING count(DISTINCT page_index) >= 4)
        SELECT t.doc_id, t.text, t.page_number, CASE region_type WHEN 'footnote' THEN 'note' WHEN 'body' THEN 'body' ELSE 'unknown' END AS note_class, t.reading_order FROM t
        LEFT JOIN heads h ON h.doc_id = t.doc_id AND h.key = regexp_replace(lower(t.text), '[^a-z0-9]', '', 'g')
        WHERE region_type NOT IN ('header', 'footer') AND NOT (h.key IS NOT NULL AND (y1 < 800 * 0.155 OR y0 > 800 * 0.84))"""
    ),
)
def statute_line_stream(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("spans", F.array().cast("array<struct<text:string,start:int,end:int,superscript:boolean>>")).withColumns({"note_region_mode": F.lit(""), "source_index": F.col("reading_order")})
    return L.statute_lines(rows, pages(spark, sf_dir)).select("doc_id", "text", "page_number", "note_class", F.col("seq.reading_order").alias("reading_order"))


@register("utf16_lengths", "SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS INTEGER) AS units FROM documents")
def utf16_lengths(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.utf16_length(F.col("text")).alias("units"))


@register("zero_width_text", LINES.over("SELECT doc_id, line_id, text || CASE WHEN k % 3 = 0 THEN ' end' ELSE 'end' END AS text FROM t"))
def zero_width_text(spark, sf_dir):
    spaced = F.concat(F.lit("﻿"), F.col("text"), F.when(F.col("k") % 3 == 0, "​​").otherwise("​"), F.lit("end"))
    return LINES.frame(spark, sf_dir).select("doc_id", "line_id", T.without_zero_widths(spaced).alias("text"))


@register("furniture_normal_text", LINES.over("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS key, count(*) AS n FROM t GROUP BY ALL"))
def furniture_normal_text(spark, sf_dir):
    return LINES.frame(spark, sf_dir).groupBy("doc_id", T.furniture_normal(F.col("text")).alias("key")).agg(F.count("*").alias("n"))


_EN, _FR = (", ".join(f"'{w}'" for w in ws) for ws in (T.ENGLISH_WORDS, T.FRENCH_WORDS))


@register("language_votes", f"SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN ({_EN}))) AS INTEGER) AS english, CAST(len(list_filter(w, lambda x: x IN ({_FR}))) AS INTEGER) AS french FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}]+') AS w FROM documents)")
def language_votes(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.stopword_votes(t, T.ENGLISH_WORDS).alias("english"), T.stopword_votes(t, T.FRENCH_WORDS).alias("french"))


# --- Order statistics ----------------------------------------------------------------------------------


@register("upper_medians", "SELECT l_suppkey, v[CAST(floor(len(v) / 2) AS INTEGER) + 1] AS upper_median, v[least(CAST(floor(len(v) * 3 / 4) AS INTEGER), len(v) - 1) + 1] AS upper_quartile FROM (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_suppkey)")
def upper_medians(spark, sf_dir):
    listed = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(stats.sorted_list(F.col("l_extendedprice")).alias("v"))
    return listed.select("l_suppkey", stats.upper_median(F.col("v")).alias("upper_median"), stats.upper_quartile(F.col("v")).alias("upper_quartile"))


@register("true_medians", "SELECT l_suppkey, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY l_suppkey")
def true_medians(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.median("l_quantity"), 6).alias("median"))


@register("nearest_rank_percentiles", "SELECT l_suppkey, v[CAST(round_even((len(v) - 1) * 0.9, 0) AS INTEGER) + 1] AS p90 FROM (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_suppkey)")
def nearest_rank_percentiles(spark, sf_dir):
    listed = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(stats.sorted_list(F.col("l_extendedprice")).alias("v"))
    return listed.select("l_suppkey", stats.nearest_rank(F.col("v"), 0.9).alias("p90"))


SPANS = "WITH t AS (SELECT doc_id, page_index, size, greatest(1, least(100, length(text))) AS w FROM " + LINES.sql + ") "


@register(
    "line_font_sizes",
    SPANS + """, r AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, page_index ORDER BY size, w ROWS UNBOUNDED PRECEDING) AS seen, sum(w) OVER (PARTITION BY doc_id, page_index) AS total FROM t)
    SELECT doc_id, page_index, min(size) FILTER (seen > floor(total / 2)) AS upper_size, (min(size) FILTER (seen > floor((total - 1) / 2)) + min(size) FILTER (seen > floor(total / 2))) / 2 AS mid_size FROM r GROUP BY doc_id, page_index""",
)
def line_font_sizes(spark, sf_dir):
    spans = LINES.frame(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.collect_list(F.struct("size", "text", F.lit(False).alias("superscript"))).alias("spans"))
    return spans.select("doc_id", "page_index", stats.line_font_size(F.col("spans")).alias("upper_size"), stats.mid_font_size(F.col("spans")).alias("mid_size"))


@register("union_boxes", LINES.over("SELECT doc_id, page_index, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM t GROUP BY ALL"))
def union_boxes(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id", "page_index").agg(stats.union_box(F.col("bbox")).alias("b")).select("doc_id", "page_index", "b.*")


@register("body_font_histogram", LINES.over(", h AS (SELECT doc_id, CAST(round(size * 100) AS BIGINT) AS bucket, sum(length(text)) AS chars FROM t GROUP BY ALL) SELECT doc_id, max(bucket) AS bucket FROM (SELECT *, sum(chars) OVER (PARTITION BY doc_id) AS total FROM h) WHERE chars >= total * 0.1 GROUP BY doc_id"))
def body_font_histogram(spark, sf_dir):
    buckets = LINES.frame(spark, sf_dir).groupBy("doc_id", F.round(F.col("size") * 100).cast("bigint").alias("bucket")).agg(F.sum(F.length("text")).alias("chars"))
    total = F.sum("chars").over(Window.partitionBy("doc_id"))
    return buckets.withColumn("total", total).where("chars >= total * 0.1").groupBy("doc_id").agg(F.max("bucket").alias("bucket"))


@register("label_runs", LINES.over(""", p AS (SELECT doc_id, CAST(n AS INTEGER) AS v, page_index * 10 + reading_order AS pos FROM t),
  r(doc_id, run, v, pos) AS (SELECT doc_id, 1, v, min(pos) FROM p GROUP BY doc_id, v UNION ALL SELECT p.doc_id, r.run + 1, p.v, min(p.pos) FROM r JOIN p ON p.doc_id = r.doc_id AND p.v - r.v BETWEEN 1 AND 3 AND p.pos > r.pos GROUP BY p.doc_id, r.run, p.v)
  SELECT doc_id, CAST(max(run) AS INTEGER) AS run FROM r GROUP BY doc_id""").replace("WITH t AS", "WITH RECURSIVE t AS", 1))
def label_runs(spark, sf_dir):
    listed = LINES.frame(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "reading_order", "n"))), lambda x: x["n"]).alias("labels"))
    return listed.select("doc_id", stats.longest_label_run(F.col("labels")).alias("run"))


# --- Geometry ------------------------------------------------------------------------------------------


@register("display_points", LINES.over("SELECT doc_id, line_id, CASE k % 4 WHEN 1 THEN y0 - 5 WHEN 2 THEN 600 - (x0 - 3) WHEN 3 THEN 800 - (y0 - 5) ELSE x0 - 3 END AS x, CASE k % 4 WHEN 1 THEN 600 - (x0 - 3) WHEN 2 THEN 800 - (y0 - 5) WHEN 3 THEN x0 - 3 ELSE y0 - 5 END AS y FROM t"))
def display_points(spark, sf_dir):
    point = geometry.to_display(F.col("x0"), F.col("y0"), F.lit(3.0), F.lit(5.0), F.lit(600.0), F.lit(800.0), F.col("k") % 4 * 90)
    return LINES.frame(spark, sf_dir).select("doc_id", "line_id", point.alias("p")).select("doc_id", "line_id", "p.x", "p.y")


@register("flipped_boxes", LINES.over("SELECT doc_id, line_id, round(x0, 3) AS x0, round(800 - y1, 3) AS y0, round(x1, 3) AS x1, round(800 - y0, 3) AS y1 FROM t"))
def flipped_boxes(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_id", geometry.flipped(F.col("bbox"), F.lit(800.0)).alias("b")).select("doc_id", "line_id", "b.*")


@register("valid_boxes", LINES.over("SELECT doc_id, count(*) AS valid FROM t WHERE x1 > x0 AND y1 > y0 GROUP BY doc_id"))
def valid_boxes(spark, sf_dir):
    return lines(spark, sf_dir).where(geometry.is_valid(F.col("bbox"))).groupBy("doc_id").agg(F.count("*").alias("valid"))


REGION_SQL = ", r AS (SELECT doc_id, page_index, block_index AS region_id, min(x0) - 5 AS rx0, min(y0) - 5 AS ry0, max(x1) - 60 AS rx1, max(y1) + 5 AS ry1 FROM t GROUP BY ALL)"


def _regions(spark, sf_dir):
    boxed = lines(spark, sf_dir).groupBy("doc_id", "page_index", F.col("block_index").alias("region_id")).agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    return boxed.select("doc_id", "page_index", "region_id", F.struct((F.col("a") - 5).alias("x0"), (F.col("b") - 5).alias("y0"), (F.col("c") - 60).alias("x1"), (F.col("d") + 5).alias("y1")).alias("bbox"))


@register(
    "line_regions",
    LINES.over(
        REGION_SQL + """, p AS (SELECT t.doc_id, t.page_index, line_id, region_id, rx0 <= x0 AND ry0 <= y0 AND rx1 >= x1 AND ry1 >= y1 AS inside, greatest(rx1 - rx0, 0) * greatest(ry1 - ry0, 0) AS area,
          greatest(least(x1, rx1) - greatest(x0, rx0), 0) * greatest(least(y1, ry1) - greatest(y0, ry0), 0) / ((x1 - x0) * (y1 - y0)) AS share FROM t JOIN r USING (doc_id, page_index) WHERE x1 > x0 AND y1 > y0)
        SELECT doc_id, page_index, line_id, region_id FROM p WHERE inside OR share >= 0.1 QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, line_id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN area ELSE -share END, region_id) = 1"""
    ),
)
def line_regions(spark, sf_dir):
    return regions.assign_regions(lines(spark, sf_dir), _regions(spark, sf_dir))


@register("region_contexts", LINES.over("SELECT doc_id, page_index, block_index AS region_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars, string_agg(text, ' ' ORDER BY reading_order) AS text FROM t GROUP BY ALL"))
def region_contexts(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return regions.region_contexts(rows.select("doc_id", "page_index", "line_id", F.col("block_index").alias("region_id")), rows)


# --- Furniture and labels ------------------------------------------------------------------------------


@register("edge_repeats", LINES.over(""", h AS (SELECT doc_id, page_index, page_number % 2 AS parity, 'revenue act of #' AS key, (12 + k % 4 * 7) / 800 AS y, (150 + k % 3 * 30) / 600 AS x FROM t WHERE reading_order = 0),
  i AS (SELECT h.*, s.y AS start FROM h JOIN (SELECT DISTINCT doc_id, y FROM h) s ON s.doc_id = h.doc_id AND h.y >= s.y AND h.y - s.y <= 0.015),
  c AS (SELECT DISTINCT doc_id, start, parity, x FROM i),
  n AS (SELECT c.doc_id, c.start, c.parity, c.x, count(DISTINCT i.page_index) AS pages FROM c JOIN i ON i.doc_id = c.doc_id AND i.start = c.start AND i.parity = c.parity AND i.x >= c.x AND i.x - c.x <= 0.04 GROUP BY ALL),
  b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, start, parity ORDER BY pages DESC, x DESC) = 1),
  g AS (SELECT i.* FROM i JOIN b ON b.doc_id = i.doc_id AND b.start = i.start AND b.parity = i.parity AND i.x >= b.x AND i.x - b.x <= 0.04),
  y AS (SELECT doc_id, start, count(DISTINCT page_index) AS pages FROM g GROUP BY ALL), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pages DESC, start) = 1),
  w AS (SELECT doc_id, least(4, greatest(2, ceil(count(DISTINCT page_index) * 0.35))) AS least_pages FROM t GROUP BY doc_id)
  SELECT g.doc_id, 'top' AS edge, 'revenue act of #' AS key, count(*) AS lines, max(pages) AS pages FROM g JOIN z ON z.doc_id = g.doc_id AND z.start = g.start JOIN w ON w.doc_id = g.doc_id WHERE pages >= least_pages GROUP BY g.doc_id"""))
def edge_repeats(spark, sf_dir):
    head = F.col("reading_order") == 0
    y = F.when(head, (12 + F.col("k") % 4 * 7).cast("double")).otherwise(F.lit(300.0))
    x = (100 + F.col("k") % 3 * 30).cast("double")
    rows = lines(spark, sf_dir).withColumn("bbox", F.struct(x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 12).alias("y1"))).drop("page_number")
    return furniture.repeated_lines(rows, pages(spark, sf_dir)).groupBy("doc_id", "edge", "key").agg(F.count("*").alias("lines"), F.max("pages").alias("pages"))


@register("folio_sequences", LINES.over("SELECT doc_id, count(*) AS folios FROM t WHERE reading_order = 9 GROUP BY doc_id HAVING count(*) >= 4"))
def folio_sequences(spark, sf_dir):
    y = F.when(F.col("reading_order") == 9, 760.0).otherwise(F.col("y0") / 2)
    rows = lines(spark, sf_dir).withColumn("bbox", F.struct(F.lit(290.0).alias("x0"), y.alias("y0"), F.lit(310.0).alias("x1"), (y + 15).alias("y1"))).drop("page_number")
    return furniture.folio_runs(rows, pages(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("folios"))


@register("printed_page_labels", LINES.over("SELECT doc_id, page_index, CAST(page_number AS VARCHAR) AS printed_label, 'footer' AS printed_label_source FROM t WHERE reading_order = 9"))
def printed_page_labels(spark, sf_dir):
    return furniture.printed_labels(lines(spark, sf_dir)).select("doc_id", "page_index", "printed_label", "printed_label_source")


@register("page_number_offsets", LINES.over(", v AS (SELECT doc_id, CASE WHEN k % 4 = 0 THEN k % 3 ELSE doc_id % 5 END AS o, count(*) AS votes FROM t WHERE reading_order = 9 GROUP BY ALL HAVING count(*) >= 3) SELECT doc_id, CAST(o AS INTEGER) AS \"offset\", votes FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, o) = 1"))
def page_number_offsets(spark, sf_dir):
    shift = F.when(F.col("k") % 4 == 0, F.col("k") % 3).otherwise(F.col("doc_id") % 5)
    folio = F.concat(F.lit("- "), (F.col("page_number") + shift).cast("string"), F.lit(" -"))
    return furniture.page_offset(lines(spark, sf_dir).withColumn("text", F.when(F.col("reading_order") == 9, folio).otherwise(F.lit("words")))).select("doc_id", F.col("offset").cast("int").alias("offset"), "votes")


@register("top_line_repeats", LINES.over("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, count(DISTINCT page_index) AS pages FROM t WHERE reading_order < 4 GROUP BY ALL HAVING count(DISTINCT page_index) >= 2"))
def top_line_repeats(spark, sf_dir):
    return furniture.top_line_repeats(lines(spark, sf_dir))


@register("region_repeats", LINES.over(", p AS (SELECT doc_id, count(DISTINCT page_index) AS total FROM t GROUP BY doc_id), q AS (SELECT doc_id, page_index, CASE WHEN length(array_to_string(regexp_extract_all(lower(text), '[a-z]+'), '')) < 6 THEN '' ELSE array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') END AS key FROM t) SELECT doc_id, key, count(DISTINCT page_index) AS pages FROM q JOIN p USING (doc_id) WHERE key <> '' GROUP BY doc_id, key, total HAVING count(DISTINCT page_index) >= 3 AND count(DISTINCT page_index) >= total * 0.4"))
def region_repeats(spark, sf_dir):
    return furniture.region_repeats(lines(spark, sf_dir), pages(spark, sf_dir))


PAGE_RULES = "SELECT DISTINCT doc_id, 0 AS first, 'r' AS style, '' AS prefix, 1 AS start FROM t UNION ALL SELECT DISTINCT doc_id, 3, 'D', 'p-', 5 FROM t"


@register("embedded_page_labels", LINES.over(", pg AS (SELECT DISTINCT doc_id, page_index FROM t) SELECT doc_id, page_index, CASE page_index WHEN 0 THEN 'i' WHEN 1 THEN 'ii' WHEN 2 THEN 'iii' ELSE 'p-' || (page_index + 2) END AS label FROM pg"))
def embedded_page_labels(spark, sf_dir):
    docs = pages(spark, sf_dir)
    rule = lambda *v: docs.select("doc_id").distinct().select("doc_id", *(F.lit(x).alias(n) for n, x in zip(("first", "style", "prefix", "start"), v)))
    return files.page_labels(docs, rule(0, "r", "", 1).unionByName(rule(3, "D", "p-", 5)))


# --- Regions, paragraphs, ranges -----------------------------------------------------------------------

ISLANDS = ", s AS (SELECT *, CASE WHEN region_type IS NOT DISTINCT FROM lag(region_type) OVER w AND block_index IS NOT DISTINCT FROM lag(block_index) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY reading_order, line_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY reading_order, line_id) AS no FROM s)"


@register("region_islands", LINES.over(ISLANDS + " SELECT doc_id, page_index, CAST(no AS BIGINT) AS region_no, first(region_type) AS kind, min(x0) AS x0, max(y1) AS y1, count(*) AS n_lines FROM g GROUP BY doc_id, page_index, no"))
def region_islands(spark, sf_dir):
    return regions.region_islands(lines(spark, sf_dir)).select("doc_id", "page_index", F.col("region_no").cast("bigint").alias("region_no"), "kind", "bbox.x0", "bbox.y1", F.size("line_ids").cast("bigint").alias("n_lines"))


#: Lines are joined by a character that no text has, so that only hyphens at line ends close up.
JOINED = "replace(regexp_replace(array_to_string(list_filter(list_transform({0}, lambda x: trim(x, ' ')), lambda x: x <> ''), chr(1)), '-\\x01(\\p{{Ll}})', '\\1', 'g'), chr(1), ' ')"


@register("paragraphs", LINES.over(", t2 AS (SELECT * REPLACE (CASE WHEN k % 3 = 0 THEN lower(text) ELSE text END AS text) FROM t)" + ISLANDS.replace("FROM t ", "FROM t2 ") + ", p AS (SELECT doc_id, page_index, no, first(region_type) AS region_type, " + JOINED.format("list(text ORDER BY reading_order)") + " AS text FROM g WHERE region_type IN ('body', 'heading') GROUP BY ALL) SELECT doc_id, printf('para-%06d', row_number() OVER (PARTITION BY doc_id ORDER BY page_index, no)) AS paragraph_id, page_index, region_type, text FROM p"))
def paragraphs(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("text", F.when(F.col("k") % 3 == 0, F.lower("text")).otherwise(F.col("text")))
    return regions.paragraphs(rows).select("doc_id", "paragraph_id", "page_index", "region_type", "text")


@register("joined_page_text", f"SELECT doc_id, CAST(length({JOINED.format('string_split(text, chr(10))')}) AS INTEGER) AS n FROM documents")
def joined_page_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.length(T.joined_lines(F.split("text", "\n"))).alias("n"))


@register("text_offsets", LINES.over("SELECT doc_id, line_id, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_index, reading_order, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t"))
def text_offsets(spark, sf_dir):
    return regions.text_index(lines(spark, sf_dir)).select("doc_id", "line_id", F.col("start").cast("bigint").alias("start"))


@register("interval_overlaps", LINES.over(", i AS (SELECT doc_id, line_id, coalesce(sum(length(text) + 1) OVER w, 0) AS s, coalesce(sum(length(text) + 1) OVER w, 0) + length(text) AS e FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, reading_order, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), r AS (SELECT DISTINCT doc_id, page_index AS range_id, page_index * 500 AS a, page_index * 500 + 120 AS b FROM t) SELECT r.doc_id, range_id, line_id FROM r JOIN i ON i.doc_id = r.doc_id AND s < b AND a < e"))
def interval_overlaps(spark, sf_dir):
    asked = pages(spark, sf_dir).select("doc_id", F.col("page_index").alias("range_id"), (F.col("page_index") * 500).alias("from_char"), (F.col("page_index") * 500 + 120).alias("to_char"))
    return regions.overlapping(asked, regions.text_index(lines(spark, sf_dir))).select("doc_id", "range_id", "line_id")


@register("claim_ranges", LINES.over(", i AS (SELECT doc_id, page_index, line_id, coalesce(sum(length(text) + 1) OVER w, 0) AS s, coalesce(sum(length(text) + 1) OVER w, 0) + length(text) AS e FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, reading_order, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc_id, page_index AS claim_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS \"end\" FROM i GROUP BY doc_id, page_index"))
def claim_ranges(spark, sf_dir):
    rows = lines(spark, sf_dir)
    claims = rows.groupBy("doc_id", F.col("page_index").alias("claim_id")).agg(F.collect_list("line_id").alias("line_ids"))
    return regions.range_of_lines(claims, regions.text_index(rows)).select("doc_id", "claim_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@register("hyphen_faults", LINES.over("SELECT doc_id, line_id, code FROM (SELECT doc_id, line_id, text, CASE WHEN regexp_matches(nt, '^[A-Za-z]{2,}') AND nr <> region_type THEN 'REGION_BOUNDARY_FAULT' WHEN NOT coalesce(regexp_matches(nt, '^[A-Za-z]{2,}'), FALSE) THEN 'DANGLING_SOFT_HYPHEN' END AS code FROM (SELECT *, lead(text) OVER w AS nt, lead(region_type) OVER w AS nr FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, reading_order, line_id))) WHERE regexp_matches(text, '[A-Za-z]{2,}-$') AND code IS NOT NULL"))
def hyphen_faults(spark, sf_dir):
    return regions.hyphen_faults(lines(spark, sf_dir)).select("doc_id", "line_id", "code")


@register("nearest_note_bodies", LINES.over(", l AS (SELECT * FROM t), b AS (SELECT doc_id, page_index, line_id AS body_id, x0 AS bx, y0 - (k % 3) * 78 AS by0, y1 - (k % 3) * 78 AS by1 FROM t), m AS (SELECT l.doc_id, l.page_index, line_id, body_id, least(y1, by1) - greatest(y0, by0) AS shared, least(y1 - y0, by1 - by0) AS low, greatest(bx - x1, 0) AS gap, abs(by0 - y0) AS down FROM l JOIN b ON b.doc_id = l.doc_id AND b.page_index = l.page_index AND body_id <> line_id WHERE bx >= x0) SELECT doc_id, page_index, line_id, body_id FROM m WHERE shared > 0 AND low > 0 AND shared / low >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, line_id ORDER BY gap, down, body_id) = 1"))
def nearest_note_bodies(spark, sf_dir):
    rows = lines(spark, sf_dir)
    up = (F.col("k") % 3) * 78
    bodies = rows.withColumn("bbox", F.struct("x0", (F.col("y0") - up).alias("y0"), "x1", (F.col("y1") - up).alias("y1")))
    return regions.nearest_label(rows, bodies)


# --- Reading order and layout ---------------------------------------------------------------------------


@register("geometry_ranks", LINES.over("SELECT doc_id, page_index, line_id, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY (y0 + y1) / 2, (x0 + x1) / 2, x0, line_id) AS INTEGER) AS rank FROM t"))
def geometry_ranks(spark, sf_dir):
    return layout.geometry_order(lines(spark, sf_dir))


@register("page_reading_order", LINES.over("SELECT doc_id, page_index, line_id, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE region_type WHEN 'header' THEN 0 WHEN 'footer' THEN 3 WHEN 'footnote' THEN 2 ELSE 1 END, k, line_id) - 1 AS INTEGER) AS reading_order FROM t"))
def page_reading_order(spark, sf_dir):
    return layout.page_order(lines(spark, sf_dir).withColumn("source_order", F.col("k")))


GUTTER = """, c AS (SELECT doc_id, page_index, line_id, x0, x1, y0, y1, (x0 + x1) / 2 AS cx, (x1 - x0) / 600 AS share FROM t WHERE region_type NOT IN ('header', 'footer')),
f AS (SELECT doc_id, page_index FROM c GROUP BY ALL HAVING count(*) FILTER (share <= 0.55) >= 6 AND 1 - count(*) FILTER (share <= 0.55) / count(*) <= 0.4), r AS (SELECT c.* FROM c JOIN f USING (doc_id, page_index) WHERE share <= 0.55),
s AS (SELECT doc_id, page_index, (cx + nx) / 2 AS split_x, nx - cx AS gap FROM (SELECT *, lead(cx) OVER (PARTITION BY doc_id, page_index ORDER BY cx, line_id) AS nx FROM r) WHERE (nx - cx) / 600 >= 0.12 AND (cx + nx) / 1200 BETWEEN 0.25 AND 0.75),
g AS (SELECT s.doc_id, s.page_index, split_x, gap, count(*) FILTER (x0 < split_x AND x1 > split_x) AS crossings, count(*) FILTER (cx < split_x) AS ln, count(*) FILTER (cx >= split_x) AS rn,
  max(y1) FILTER (cx < split_x) AS le, max(y1) FILTER (cx >= split_x) AS re, min(y0) FILTER (cx < split_x) AS lt, min(y0) FILTER (cx >= split_x) AS rt FROM s JOIN r ON r.doc_id = s.doc_id AND r.page_index = s.page_index GROUP BY ALL)
SELECT doc_id, page_index, split_x, crossings FROM g WHERE ln >= 3 AND rn >= 3 AND greatest(le, re) - least(lt, rt) > 0 AND greatest(least(le, re) - greatest(lt, rt), 0) / (greatest(le, re) - least(lt, rt)) >= 0.3
QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY crossings, -gap, split_x) = 1"""


@register("column_models", LINES.over(GUTTER))
def column_models(spark, sf_dir):
    return layout.column_models(lines(spark, sf_dir), pages(spark, sf_dir)).select("doc_id", "page_index", "split_x", "crossings")


@register("column_reading_order")
def column_reading_order(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return layout.column_order(rows, layout.column_models(rows, pages(spark, sf_dir)))


@register("column_runs", LINES.over(", s AS (SELECT *, CASE WHEN k % 2 = lag(k % 2) OVER (PARTITION BY doc_id, page_index ORDER BY reading_order, line_id) THEN 0 ELSE 1 END AS new FROM t), r AS (SELECT doc_id, page_index, sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY reading_order, line_id) AS run FROM s), n AS (SELECT doc_id, page_index, run, count(*) AS n FROM r GROUP BY ALL) SELECT doc_id, page_index, v[CAST(floor(len(v) / 2) AS INTEGER) + 1] AS median_run FROM (SELECT doc_id, page_index, list_sort(list(n)) AS v FROM n GROUP BY ALL)"))
def column_runs(spark, sf_dir):
    return layout.column_runs(lines(spark, sf_dir).withColumn("column_no", F.col("k") % 2))


@register("order_scores", LINES.over("SELECT doc_id, page_index, count(*) FILTER (k % 2 <> pk % 2) AS switches, count(*) FILTER (regexp_matches(pt, '[A-Za-z]{2,}-$')) AS hyphens, count(*) FILTER (y0 < py) AS regressions FROM (SELECT *, lag(k) OVER w AS pk, lag(text) OVER w AS pt, lag(y0) OVER w AS py FROM t WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY reading_order, line_id)) GROUP BY ALL"))
def order_scores(spark, sf_dir):
    return layout.order_scores(lines(spark, sf_dir).withColumn("column_no", F.col("k") % 2)).select("doc_id", "page_index", "switches", "hyphens", "regressions")


@register("contents_pages", LINES.over(", n AS (SELECT doc_id, page_index, reading_order, line_id, k % 97 AS v FROM t), s AS (SELECT *, v >= lag(v) OVER (PARTITION BY doc_id, page_index ORDER BY reading_order, line_id) AS ok FROM n) SELECT doc_id, page_index, count(*) AS entries, count(*) FILTER (ok) AS rises FROM s GROUP BY ALL HAVING count(*) >= 6 AND count(*) FILTER (ok) >= 0.8 * (count(*) - 1)"))
def contents_pages(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumns({"text": F.concat(F.lit("Levy "), (F.col("k") % 97).cast("string")), "bbox": F.struct("x0", "y0", F.lit(590.0).alias("x1"), "y1")})
    return layout.contents_grid(rows, pages(spark, sf_dir).drop("page_number"))


@register("table_rows", LINES.over(", h AS (SELECT doc_id, page_index, list_sort(list(y1 - y0)) AS v FROM t GROUP BY ALL), c AS (SELECT t.doc_id, t.page_index, CAST(round(((y0 + y1) / 2) / (0.75 * v[CAST(floor(len(v) / 2) AS INTEGER) + 1])) AS BIGINT) AS row_no FROM t JOIN h USING (doc_id, page_index)) SELECT doc_id, page_index, row_no, count(*) AS cells FROM c GROUP BY ALL"))
def table_rows(spark, sf_dir):
    return layout.table_rows(lines(spark, sf_dir)).select("doc_id", "page_index", "row_no", "cells")


@register("overlap_suppression", LINES.over(""", b AS (SELECT doc_id, page_index, line_id, x0, x1, y0 / 10 AS y0, y1 / 10 + 10 AS y1, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY k DESC, line_id DESC) AS i FROM t),
  r(doc_id, page_index, i, kept) AS (SELECT doc_id, page_index, 1::BIGINT, [{'id': line_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] FROM b WHERE i = 1
    UNION ALL SELECT b.doc_id, b.page_index, b.i, CASE WHEN len(list_filter(r.kept, lambda q: greatest(least(q.x1, b.x1) - greatest(q.x0, b.x0), 0) * greatest(least(q.y1, b.y1) - greatest(q.y0, b.y0), 0)
        / ((q.x1 - q.x0) * (q.y1 - q.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(least(q.x1, b.x1) - greatest(q.x0, b.x0), 0) * greatest(least(q.y1, b.y1) - greatest(q.y0, b.y0), 0)) >= 0.35)) = 0
      THEN list_append(r.kept, {'id': b.line_id, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}) ELSE r.kept END FROM r JOIN b ON b.doc_id = r.doc_id AND b.page_index = r.page_index AND b.i = r.i + 1),
  last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY i DESC) = 1)
  SELECT doc_id, page_index, unnest(list_transform(kept, lambda q: q.id)) AS box_id FROM last""").replace("WITH t AS", "WITH RECURSIVE t AS", 1))
def overlap_suppression(spark, sf_dir):
    boxes = lines(spark, sf_dir).select("doc_id", "page_index", F.col("line_id").alias("box_id"), F.col("k").alias("score"), F.struct("x0", (F.col("y0") / 10).alias("y0"), "x1", (F.col("y1") / 10 + 10).alias("y1")).alias("bbox"))
    return layout.suppress_overlaps(boxes)


@register("top_detections", LINES.over("SELECT doc_id, page_index, line_id AS box_id, CAST(rank AS INTEGER) AS rank, round(1 / (1 + exp(-logit)), 6) AS score FROM (SELECT *, (k % 11 - 4) / 2.0 AS logit, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY k % 11 DESC, line_id) AS rank FROM t) WHERE rank <= 3 AND 1 / (1 + exp(-logit)) >= 0.5"))
def top_detections(spark, sf_dir):
    scores = LINES.frame(spark, sf_dir).select("doc_id", "page_index", F.col("line_id").alias("box_id"), ((F.col("k") % 11 - 4) / 2).alias("logit"))
    return layout.top_detections(scores, 3, 0.5).withColumn("score", F.round("score", 6))


@register("width_batches", LINES.over("SELECT line_id, CAST(ceil((x1 - x0) / 50) AS INTEGER) AS bucket, CAST(floor((row_number() OVER (PARTITION BY ceil((x1 - x0) / 50) ORDER BY line_id) - 1) / 8) AS INTEGER) AS batch FROM (SELECT concat(doc_id, '-', line_id) AS line_id, x0, x1 FROM t)"))
def width_batches(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).select(F.concat_ws("-", "doc_id", "line_id").alias("line_id"), (F.col("x1") - F.col("x0")).alias("line_width"))
    return layout.length_buckets(rows, 50, 8).select("line_id", "bucket", "batch")


@register("double_painted_items", LINES.over("SELECT doc_id, seq, word FROM (SELECT doc_id, page_index, page_index * 10 + reading_order AS seq, k % 3 AS word, lag(k % 3) OVER (PARTITION BY doc_id, page_index ORDER BY page_index * 10 + reading_order) AS pw FROM t) WHERE pw IS NULL OR pw <> word"))
def double_painted_items(spark, sf_dir):
    at = F.struct(F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"))
    items = LINES.frame(spark, sf_dir).select("doc_id", "page_index", (F.col("page_index") * 10 + F.col("reading_order")).alias("seq"), (F.col("k") % 3).alias("word"), (F.col("k") % 3).cast("string").alias("text"), at.alias("bbox"))
    return layout.double_painted(items).select("doc_id", "seq", "word")


# --- Notes ---------------------------------------------------------------------------------------------


def _notes(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).where("reading_order = 8")
    return rows.select("doc_id", F.col("line_id").alias("pair_id"), F.col("n").cast("string").alias("label"), F.col("text").alias("body"), F.floor(F.col("page_index") / 4).cast("int").alias("restart_sequence"))


@register(
    "note_crossrefs",
    LINES.over(
        """, n AS (SELECT doc_id, line_id AS pair_id, n AS label, CAST(floor(page_index / 4) AS INTEGER) AS rs, CAST(k % 9 + 1 AS INTEGER) AS a, CAST(k % 4 + 1 AS INTEGER) AS b FROM t WHERE reading_order = 8),
        f AS (SELECT doc_id, pair_id, rs, 'supra' AS kind, a AS number FROM n UNION ALL SELECT doc_id, pair_id, rs, 'infra', b FROM n),
        e AS (SELECT doc_id, label, count(*) AS c, min(pair_id) AS only_id FROM n GROUP BY ALL), s AS (SELECT doc_id, label, rs, count(*) AS c, min(pair_id) AS only_id FROM n GROUP BY ALL)
        SELECT f.doc_id, f.pair_id AS source_pair_id, kind, number, e.c IS NOT NULL AS resolved, CASE WHEN e.c = 1 THEN e.only_id WHEN s.c = 1 THEN s.only_id ELSE '' END AS target_pair_id, coalesce(e.c, 0) AS target_count
        FROM f LEFT JOIN e ON e.doc_id = f.doc_id AND e.label = f.number LEFT JOIN s ON s.doc_id = f.doc_id AND s.label = f.number AND s.rs = f.rs"""
    ),
)
def note_crossrefs(spark, sf_dir):
    return notes.crossrefs(_notes(spark, sf_dir)).select("doc_id", "source_pair_id", "kind", "number", "resolved", "target_pair_id", "target_count")


@register("note_mark_numbers", LINES.over(", m AS (SELECT doc_id, page_index * 10 + reading_order AS ordinal, CAST(k % 20 AS VARCHAR) AS pair_id, length(text) AS pos FROM t), f AS (SELECT doc_id, pair_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(ordinal)) AS note_number FROM m GROUP BY doc_id, pair_id) SELECT doc_id, ordinal, pair_id, CAST(note_number AS INTEGER) AS note_number, CAST(pos AS BIGINT) AS \"offset\" FROM m JOIN f USING (doc_id, pair_id)"))
def note_mark_numbers(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).select("doc_id", (F.col("page_index") * 10 + F.col("reading_order")).alias("ordinal"), F.concat(F.col("text"), F.lit("⟦FN:"), (F.col("k") % 20).cast("string"), F.lit("⟧ more")).alias("text"))
    return notes.renumbered(rows).select("doc_id", "ordinal", "pair_id", "note_number", F.col("offset").cast("bigint").alias("offset"))


@register("note_propositions", LINES.over("SELECT doc_id, CAST(page_index * 10 + reading_order AS INTEGER) AS ordinal, line_id AS pair_id, CASE WHEN text LIKE '%.' THEN text ELSE text || ' more.' END AS sentence, 'It began. ' || text AS passage FROM t WHERE region_type = 'body'"))
def note_propositions(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).where("region_type = 'body'").select("doc_id", (F.col("page_index") * 10 + F.col("reading_order")).alias("ordinal"), F.concat(F.lit("It began. "), F.col("text"), F.lit("⟦FN:"), F.col("line_id"), F.lit("⟧ more. It ended.")).alias("text"))
    return notes.propositions(rows)


@register("note_pairs", LINES.over(", l AS (SELECT doc_id, page_number AS value, page_index, line_id AS label_id FROM t WHERE reading_order = 8), m AS (SELECT doc_id, page_number - CAST(k % 2 AS INTEGER) AS value, page_index, line_id AS ref_id FROM t WHERE reading_order = 4) SELECT l.doc_id, CAST(0 AS INTEGER) AS chain, CAST(l.value AS INTEGER) AS value, label_id, ref_id FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.value = l.value AND m.page_index BETWEEN l.page_index - 1 AND l.page_index"))
def note_pairs(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir)
    place = F.col("page_index") * 10 + F.col("reading_order")
    labels = rows.where("reading_order = 8").select("doc_id", F.col("page_number").alias("value"), "page_index", place.alias("place"), F.lit(1.0).alias("score"), F.col("line_id").alias("label_id"))
    marks = rows.where("reading_order = 4").select("doc_id", (F.col("page_number") - F.col("k") % 2).alias("value"), "page_index", place.alias("place"), F.col("line_id").alias("ref_id"))
    return notes.pair_notes(labels, marks)


@register("unmatched_marks", LINES.over("SELECT doc_id, line_id, CAST(k % 5 AS VARCHAR) AS label FROM t WHERE k % 5 <> n"))
def unmatched_marks(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir)
    return notes.unmatched(rows.select("doc_id", "line_id", F.col("n").cast("string").alias("label")), rows.select("doc_id", "line_id", (F.col("k") % 5).cast("string").alias("label")))


@register("repeated_marks", LINES.over(", p AS (SELECT doc_id, k % 5 AS value, min(page_index * 10 + reading_order) AS place FROM t GROUP BY ALL) SELECT t.doc_id, CAST(k % 5 AS BIGINT) AS value, line_id AS ref_id FROM t JOIN p ON p.doc_id = t.doc_id AND p.value = k % 5 WHERE page_index * 10 + reading_order > place"))
def repeated_marks(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).select("doc_id", (F.col("k") % 5).alias("value"), (F.col("page_index") * 10 + F.col("reading_order")).alias("place"), F.col("line_id").alias("ref_id"))
    first = rows.groupBy("doc_id", "value").agg(F.min_by("ref_id", "place").alias("ref_id"), F.min("place").alias("place"))
    return notes.repeated_references(first, rows).select("doc_id", "value", "ref_id")


# --- Headings --------------------------------------------------------------------------------------------


@register("heading_ladder")
def heading_ladder(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).where("reading_order = 3").select("doc_id", F.col("page_index").cast("bigint").alias("seq"), F.substring("text", 1, 1).alias("value"), F.lit(".").alias("punct"))
    return ladder.heading_ladder(rows)


@register("outline_parents", LINES.over(", h AS (SELECT doc_id, page_index * 10 + reading_order AS seq, line_id AS node_id, CAST(n % 4 + 1 AS INTEGER) AS level FROM t) SELECT h.doc_id, h.node_id, (SELECT max(p.node_id) FROM h p WHERE p.doc_id = h.doc_id AND p.level < h.level AND p.seq < h.seq) AS parent_id FROM h"))
def outline_parents(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).select("doc_id", (F.col("page_index") * 10 + F.col("reading_order")).alias("seq"), F.col("line_id").alias("node_id"), (F.col("n") % 4 + 1).alias("level"))
    return regions.outline_parents(rows).select("doc_id", "node_id", "parent_id")


# --- Lookup ------------------------------------------------------------------------------------------------


def _units(spark, sf_dir):
    base = LINES.frame(spark, sf_dir)
    paged = base.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"]), " ").alias("text"))
    return paged.select("doc_id", F.lit("page").alias("kind"), (F.col("page_index") + 1).alias("ordinal"), F.format_string("p%04d", F.col("page_index") + 1).alias("unit_id"), (F.col("page_index") + 1).cast("string").alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("locator_kind"), F.lit(1).alias("occurrence"), F.array(F.col("page_index") + 1).alias("pages"), "text")


@register("lookup_pages", LINES.over(", p AS (SELECT doc_id, max(page_index) + 1 AS top FROM t GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'invalid' WHEN 3 <= top THEN 'found' ELSE 'not_found' END AS status, CAST(CASE WHEN doc_id % 3 <> 2 AND 3 <= top THEN 2 ELSE 0 END AS INTEGER) AS units FROM p"))
def lookup_pages(spark, sf_dir):
    units = _units(spark, sf_dir)
    asked = units.select("doc_id").distinct().select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("request_id"), "doc_id", F.lit("page").alias("kind"), F.when(F.col("doc_id") % 3 == 2, "pp. 9-3").when(F.col("doc_id") % 3 == 1, "pages 2–3").otherwise("p 2 to 3").alias("locator"), F.lit("").alias("end_locator"), F.lit(1).alias("context"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("occurrence"))
    return lookup.lookup(units, asked).select("doc_id", "status", F.size("selected").alias("units"))


@register("locator_ranges", "SELECT DISTINCT l_linenumber AS a, CAST(l_linenumber AS INTEGER) AS first, CAST(l_linenumber + 2 AS INTEGER) AS last FROM lineitem")
def locator_ranges(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a")).distinct()
    text = F.concat(F.lit("#[ pages "), F.col("a").cast("string"), F.lit(" – "), (F.col("a") + 2).cast("string"), F.lit("]"))
    return rows.select("a", locators.numeric_range(F.lit("page"), text).alias("r")).select("a", "r.first", "r.last")


@register("section_keys", "SELECT DISTINCT l_linenumber AS a, concat('ection', l_linenumber, 'a(2)') AS key FROM lineitem")
def section_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a")).distinct()
    return rows.select("a", locators.section_key(F.concat(F.lit(" Section  "), F.col("a").cast("string"), F.lit("A (2) "))).alias("key"))


@register("rendered_ranges", "SELECT conv_id AS doc_id, turn AS seq, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rendered_start, sha256(string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS revision FROM conversations".replace("string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "(SELECT string_agg(c.text, chr(10) ORDER BY c.turn) FROM conversations c WHERE c.conv_id = conversations.conv_id)"))
def rendered_ranges(spark, sf_dir):
    units = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text")
    return lookup.rendered_ranges(units).select("doc_id", "seq", F.col("rendered_start").cast("bigint").alias("rendered_start"), "revision")


@register("page_passages", LINES.over("SELECT DISTINCT doc_id, page_index, CASE WHEN page_index % 3 = 0 THEN 'ocr' ELSE 'native' END AS source FROM t"))
def page_passages(spark, sf_dir):
    base = pages(spark, sf_dir)
    native = base.select("doc_id", "page_index", F.when(F.col("page_index") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("lines"))
    return lookup.page_passages(native, base.select("doc_id", "page_index", F.array(F.lit("y")).alias("lines"))).select("doc_id", "page_index", "source")


# --- Corpus ------------------------------------------------------------------------------------------------

MANIFEST = "SELECT concat('d', o_orderkey) AS id, o_orderpriority AS jurisdiction, o_orderstatus AS source_family, CAST(o_custkey % 40 + 1 AS BIGINT) AS pages, o_orderkey % 17 <> 0 AS ok, concat('a/', o_orderkey, '.pdf') AS relative_path, sha256(CAST(o_orderkey AS VARCHAR)) AS source_sha256, CAST(o_custkey % 90 AS BIGINT) AS nodes FROM orders"


def _manifest(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.selectExpr("concat('d', o_orderkey) AS id", "o_orderpriority AS jurisdiction", "o_orderstatus AS source_family", "o_custkey % 40 + 1 AS pages", "o_orderkey % 17 <> 0 AS ok", "concat('a/', o_orderkey, '.pdf') AS relative_path", "sha2(cast(o_orderkey as string), 256) AS source_sha256", "o_custkey % 90 AS nodes")


@register("corpus_report", f"WITH m AS ({MANIFEST}) SELECT jurisdiction, source_family, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, count(*) FILTER (NOT ok) AS failures FROM m GROUP BY GROUPING SETS ((), (jurisdiction), (source_family))")
def corpus_report(spark, sf_dir):
    return corpus.report(_manifest(spark, sf_dir))


@register("corpus_top10", f"WITH m AS ({MANIFEST}) SELECT id, nodes, pages FROM m ORDER BY nodes DESC, pages DESC, id LIMIT 10")
def corpus_top10(spark, sf_dir):
    return corpus.most(_manifest(spark, sf_dir), "nodes", "pages").select("id", "nodes", "pages")


@register("corpus_denominators", f"WITH m AS ({MANIFEST}) SELECT count(*) FILTER (ok) AS successful_documents, CAST(sum(pages) FILTER (ok) AS BIGINT) AS successful_pages, count(*) FILTER (NOT ok) AS failures, CAST(sum(pages) FILTER (NOT ok) AS BIGINT) AS failure_pages, count(*) AS attempts FROM m")
def corpus_denominators(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return corpus.denominators(m.where("ok"), m.where("not ok"))


@register("corpus_gate", f"WITH m AS ({MANIFEST}) SELECT count(*) FILTER (ok) AS documents, CAST(sum(pages) FILTER (ok) AS BIGINT) AS pages, count(*) FILTER (NOT ok) AS failures, FALSE AS pass FROM m")
def corpus_gate(spark, sf_dir):
    return corpus.gate(_manifest(spark, sf_dir), 1, 1, 0, 10.0)


@register("manifest_faults", f"WITH m AS ({MANIFEST}) SELECT id, 'pages' AS rule FROM m WHERE pages % 10 = 0")
def manifest_faults(spark, sf_dir):
    m = _manifest(spark, sf_dir).withColumn("pages", F.when(F.col("pages") % 10 == 0, 0).otherwise(F.col("pages")))
    return corpus.manifest_faults(m, m.limit(0).withColumn("error_code", F.lit("x")))


@register("manifest_paths", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 2 THEN TRUE ELSE FALSE END AS ok FROM orders")
def manifest_paths(spark, sf_dir):
    path = F.when(F.col("o_orderkey") % 4 == 0, "/abs/a.pdf").when(F.col("o_orderkey") % 4 == 1, "a/../b.pdf").when(F.col("o_orderkey") % 4 == 2, "a/b.PDF").otherwise("a/b.txt")
    return read(spark, sf_dir, "orders").select("o_orderkey", files.manifest_path_ok(path).alias("ok"))


@register("document_status", LINES.over(", d AS (SELECT doc_id, max(page_index) + 1 AS top FROM t GROUP BY doc_id) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ocr_required' WHEN 1 THEN 'degraded' ELSE 'ready' END AS status FROM d"))
def document_status(spark, sf_dir):
    p = pages(spark, sf_dir)
    code = F.when(F.col("doc_id") % 3 == 0, "OCR_REQUIRED").when(F.col("doc_id") % 3 == 1, "FOOTNOTE_UNMATCHED_LABEL").otherwise("OTHER")
    return corpus.status(p, p.select("doc_id", "page_index", code.alias("code"), F.lit("warning").alias("severity")))


@register("counts_by_kind", LINES.over("SELECT doc_id, region_type AS kind, count(*) AS n FROM t GROUP BY ALL"))
def counts_by_kind(spark, sf_dir):
    return corpus.counts_by(LINES.frame(spark, sf_dir), "region_type").select("doc_id", F.explode("counts").alias("kind", "n"))


@register("record_digests", "SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def record_digests(spark, sf_dir):
    return corpus.digest(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "digest")


@register("document_ids", "SELECT doc_id, 'doc-' || substr(sha256(text), 1, 20) AS id FROM documents")
def document_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", corpus.document_id(F.col("text").cast("binary")).alias("id"))


@register("constraint_violations", LINES.over("SELECT doc_id, 'line_without_page' AS rule, line_id AS item FROM t WHERE page_index = 2"))
def constraint_violations(spark, sf_dir):
    return corpus.violations(pages(spark, sf_dir).where("page_index <> 2"), lines(spark, sf_dir))


@register("cache_retention", "SELECT o_orderkey AS path FROM (SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS held FROM orders) WHERE held <= 100000")
def cache_retention(spark, sf_dir):
    cache = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("bytes"), F.col("o_orderdate").alias("modified"))
    return corpus.retained(cache, 100_000).select("path")


@register("latency_summary", "SELECT count(*) AS batches, CAST(sum(l_linenumber) AS BIGINT) AS lines, any_value(s[CAST(ceil((len(s) - 1) * 50 / 100) AS INTEGER) + 1]) AS p50, any_value(s[CAST(ceil((len(s) - 1) * 95 / 100) AS INTEGER) + 1]) AS p95 FROM lineitem, (SELECT list_sort(list(l_extendedprice)) AS s FROM lineitem)")
def latency_summary(spark, sf_dir):
    b = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("lines"), F.lit(1.0).alias("used"), F.lit(2.0).alias("padded"), F.col("l_extendedprice").alias("seconds"))
    return corpus.latency_summary(b).select("batches", "lines", "p50", "p95")


# --- Sources ------------------------------------------------------------------------------------------------

@register(
    "ocr_table_lines",
    "WITH t AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity) AS rn, l_partkey, l_linenumber FROM lineitem), w AS (SELECT *, l_partkey % 101 - 1 AS conf FROM t WHERE l_partkey % 4 <> 0) SELECT CAST(l_suppkey AS VARCHAR) AS block_num, CAST(l_orderkey AS VARCHAR) AS line_num, string_agg('w' || l_partkey, ' ' ORDER BY rn) AS text, CAST(min(l_partkey % 500) AS DOUBLE) AS x0, CAST(max(l_partkey % 500 + l_linenumber * 3) AS DOUBLE) AS x1, round(coalesce(avg(conf) FILTER (conf >= 0) / 100, 0), 6) AS confidence FROM w GROUP BY l_suppkey, l_orderkey",
)
def ocr_table_lines(spark, sf_dir):
    order = Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity")
    rows = read(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(order))
    s = lambda c: c.cast("string")
    tsv = rows.select(
        F.when(F.col("l_partkey") % 4 == 0, "4").otherwise("5").alias("level"), F.lit("1").alias("page_num"), s(F.col("l_suppkey")).alias("block_num"), F.lit("1").alias("par_num"), s(F.col("l_orderkey")).alias("line_num"), s(F.col("rn")).alias("word_num"),
        s(F.col("l_partkey") % 500).alias("left"), F.lit("10").alias("top"), s(F.col("l_linenumber") * 3).alias("width"), F.lit("12").alias("height"), s(F.col("l_partkey") % 101 - 1).alias("conf"), F.concat(F.lit("w"), s(F.col("l_partkey"))).alias("text"),
    )
    return files.ocr_lines(tsv).select("block_num", "line_num", "text", "bbox.x0", "bbox.x1", F.round("confidence", 6).alias("confidence"))


@register("pdf_acceptance", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND strlen(text) + 5 <= 1024")
def pdf_acceptance(spark, sf_dir):
    content = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 2 == 0, F.lit("%PDF-1.7")).otherwise(F.lit("PDF")).cast("binary"))
    return read(spark, sf_dir, "documents").where(files.is_pdf(content)).select("doc_id")


@register("page_selections", "SELECT DISTINCT l_linenumber AS a, CASE WHEN l_linenumber > 5 THEN NULL ELSE CASE WHEN l_linenumber = 1 THEN [0] WHEN l_linenumber = 2 THEN [0, 1] ELSE [0, l_linenumber - 1] END END AS pages FROM lineitem".replace("CASE WHEN l_linenumber > 5 THEN NULL ELSE CASE WHEN l_linenumber = 1 THEN [0] WHEN l_linenumber = 2 THEN [0, 1] ELSE [0, l_linenumber - 1] END END AS pages", "CAST(CASE WHEN l_linenumber > 5 THEN -1 WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS INTEGER) AS n"))
def page_selections(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("a")).distinct()
    return rows.select("a", F.coalesce(F.size(files.page_selection(F.array(F.col("a"), F.lit(1), F.col("a")), F.lit(5))), F.lit(-1)).alias("n"))


@register("roman_numerals", "SELECT DISTINCT l_linenumber AS a, CASE l_linenumber WHEN 1 THEN 'CDI' WHEN 2 THEN 'CDII' WHEN 3 THEN 'CDIII' WHEN 4 THEN 'CDIV' WHEN 5 THEN 'CDV' WHEN 6 THEN 'CDVI' ELSE 'CDVII' END AS roman, CAST(400 + l_linenumber AS INTEGER) AS value FROM lineitem")
def roman_numerals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a")).distinct().withColumn("roman", files.roman_numeral(F.lit(400) + F.col("a")))
    return rows.select("a", "roman", shapes.roman_value(F.col("roman")).alias("value"))


@register("weak_page_routing", LINES.over("SELECT DISTINCT doc_id, page_index, CASE WHEN page_index % 2 = 0 THEN 'recognised' ELSE 'OCR_REQUIRED' END AS state FROM t WHERE page_index % 3 = 0"))
def weak_page_routing(spark, sf_dir):
    p = pages(spark, sf_dir)
    return files.weak_pages(p.withColumn("text_quality", F.when(F.col("page_index") % 3 == 0, 0.1).otherwise(0.9)), p.where("page_index % 2 = 0"), 0.5)


@register("uncached_sources", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def uncached_sources(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", files.cache_key(F.sha2("text", 256), "1", F.lit(None).cast("string"), F.col("doc_id")).alias("cache_key"))
    return files.to_parse(docs, docs.where("doc_id % 3 = 0")).select("doc_id")


@register("adapter_text_units")
def adapter_text_units(spark, sf_dir):
    marked = lines(spark, sf_dir).withColumn("text", F.concat("text", F.lit("⟦FN:"), "line_id", F.lit("⟧")))
    foot = LINES.frame(spark, sf_dir).where("reading_order = 8").select("doc_id", F.col("page_number").alias("number"), "text", F.array("page_number").alias("pages"))
    return X.text_units(regions.paragraphs(marked), foot)


# --- Marks and note regions --------------------------------------------------------------------------------


def _spanned(spark, sf_dir):
    """Lines with one span each; every third line of a page is a small mark beside the line before it."""
    rows = lines(spark, sf_dir)
    mark = F.col("reading_order") % 3 == 2
    box = F.struct(F.when(mark, F.col("x1") + 1).otherwise(F.col("x0")).alias("x0"), F.when(mark, F.col("y0") - 78).otherwise(F.col("y0")).alias("y0"), F.when(mark, F.col("x1") + 4).otherwise(F.col("x1")).alias("x1"), F.when(mark, F.col("y0") - 73).otherwise(F.col("y1")).alias("y1"))
    text = F.when(mark, F.col("n").cast("string")).otherwise(F.col("text"))
    rows = rows.withColumns({"bbox": box, "text": text, "region_type": F.lit("body"), "source_index": F.col("reading_order"), "block_index": F.lit(0)})
    span = F.struct("text", "bbox", F.when(mark, 5.0).otherwise(10.0).alias("size"), mark.alias("superscript"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return rows.withColumn("spans", F.array(span))


@register("detached_marks")
def detached_marks(spark, sf_dir):
    return marks.detached_references(_spanned(spark, sf_dir), pages(spark, sf_dir).withColumn("separator_y", F.lit(None).cast("double")))


@register("spliced_marks", LINES.over(", m AS (SELECT a.doc_id, a.page_index, a.line_id AS source_line_id, CAST(a.n AS VARCHAR) AS note_id, b.line_id, CAST(length(b.text) AS INTEGER) AS \"offset\" FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.page_index = a.page_index AND b.reading_order = a.reading_order - 1 WHERE a.reading_order % 3 = 2 AND a.x1 + 1 BETWEEN b.x0 - 12 AND b.x1 + 12) SELECT * FROM m"))
def spliced_marks(spark, sf_dir):
    return marks.spliced_markers(_spanned(spark, sf_dir))


@register("note_region_modes", LINES.over("SELECT doc_id, page_index, CASE WHEN page_index > 0 THEN 'footnote_continuation' ELSE '' END AS mode FROM t WHERE reading_order = 8"))
def note_region_modes(spark, sf_dir):
    return marks.note_modes(lines(spark, sf_dir).withColumn("note_region_mode", F.lit(""))).select("doc_id", "page_index", "mode")


@register("prior_references", LINES.over(", m AS (SELECT doc_id, page_index, k % 4 AS label, min(y0) AS top FROM t GROUP BY ALL) SELECT t.doc_id, t.page_index, line_id, CAST(n AS VARCHAR) AS label FROM t JOIN m ON m.doc_id = t.doc_id AND m.page_index = t.page_index AND m.label = n WHERE top < y0"))
def prior_references(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir)
    labels = rows.select("doc_id", "page_index", "line_id", F.col("n").cast("string").alias("label"), F.col("y0").alias("y"))
    return marks.prior_references(labels, rows.select("doc_id", "page_index", (F.col("k") % 4).cast("string").alias("note_id"), F.col("y0").alias("y")))


@register("note_separators")
def note_separators(spark, sf_dir):
    rows = _spanned(spark, sf_dir)
    p = pages(spark, sf_dir)
    rules = p.select("doc_id", "page_index", F.lit(50.0).alias("x0"), F.lit(300.0).alias("x1"), F.explode(F.array(F.lit(300.0), F.lit(627.0))).alias("y"))
    return marks.separators(rows, p, rules)


@register("drop_caps")
def drop_caps(spark, sf_dir):
    return marks.drop_caps(_spanned(spark, sf_dir))


@register("running_heads", LINES.over(""", c AS (SELECT doc_id, page_index, line_id, reading_order AS ro, reading_order * 8 + 4 AS y0, reading_order * 8 + 11 AS y1, x0, x1, CASE WHEN reading_order = 0 OR k % 3 = 0 THEN 8.0 WHEN k % 3 = 1 THEN 8.3 ELSE 12.0 END AS size FROM t),
  h(doc_id, page_index, ro) AS (SELECT doc_id, page_index, ro FROM c WHERE ro = 0
    UNION SELECT n.doc_id, n.page_index, n.ro FROM h JOIN c g ON g.doc_id = h.doc_id AND g.page_index = h.page_index AND g.ro = h.ro JOIN c n ON n.doc_id = h.doc_id AND n.page_index = h.page_index
      WHERE n.ro > 0 AND n.size < 9 AND abs(n.size - g.size) <= 0.5 AND (abs(n.x0 - g.x0) <= 24 OR abs((n.x0 + n.x1) - (g.x0 + g.x1)) / 2 <= 24) AND greatest(n.y0 - g.y1, g.y0 - n.y1) <= 3.5)
  SELECT c.doc_id, c.page_index, line_id FROM h JOIN c USING (doc_id, page_index, ro) WHERE ro > 0""").replace("WITH t AS", "WITH RECURSIVE t AS", 1))
def running_heads(spark, sf_dir):
    first = F.col("reading_order") == 0
    y = F.col("reading_order") * 8.0
    size = F.when(first | (F.col("k") % 3 == 0), 8.0).when(F.col("k") % 3 == 1, 8.3).otherwise(12.0)
    box = F.struct("x0", (y + 4).alias("y0"), "x1", (y + 11).alias("y1"))
    span = F.struct("text", box.alias("bbox"), size.alias("size"), F.lit(False).alias("superscript"), F.lit(0).alias("start"), F.length("text").alias("end"))
    rows = lines(spark, sf_dir).withColumns({"bbox": box, "source_index": F.col("reading_order"), "region_type": F.when(first, "header").otherwise("body"), "spans": F.array(span)})
    return marks.running_heads(rows, pages(spark, sf_dir))


@register("note_line_order")
def note_line_order(spark, sf_dir):
    rows = _spanned(spark, sf_dir)
    return marks.note_order(rows, layout.column_models(rows, pages(spark, sf_dir)))


@register("word_boxes", LINES.over(", w AS (SELECT doc_id, page_index, line_id, x0, x1, length(text) AS chars, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM t), s AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w) SELECT doc_id, line_id, CAST(pos - 1 AS INTEGER) AS pos, word, round(x0 + start * ((x1 - x0) / chars), 6) AS x0 FROM s WHERE word <> ''"))
def word_boxes(spark, sf_dir):
    return marks.word_boxes(lines(spark, sf_dir)).select("doc_id", "line_id", "pos", "word", F.round("bbox.x0", 6).alias("x0"))


@register("documents_with_regions", LINES.over("SELECT doc_id FROM t GROUP BY doc_id HAVING bool_and(k <> 13)"))
def documents_with_regions(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return marks.known_regions(rows.withColumn("region_type", F.when(F.col("k") == 13, "unknown").otherwise(F.col("region_type"))))


# --- Candidates and decisions --------------------------------------------------------------------------------


@register("note_reference_candidates")
def note_reference_candidates(spark, sf_dir):
    return candidates.reference_rows(lines(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" held."), F.col("n").cast("string"), F.lit(" so"))))


@register("note_label_candidates", LINES.over("SELECT doc_id, page_index, line_id, CAST(n AS VARCHAR) AS label, n AS value, 'plain' AS form FROM t WHERE reading_order = 8"))
def note_label_candidates(spark, sf_dir):
    return candidates.label_rows(lines(spark, sf_dir).where("region_type = 'footnote'")).select("doc_id", "page_index", "line_id", "label", "value", "form")


@register("note_bodies", LINES.over(", x AS (SELECT doc_id, line_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS note_no FROM t WHERE reading_order = 8) SELECT doc_id, note_no, text AS body FROM x"))
def note_bodies(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return candidates.note_bodies(rows, candidates.label_rows(rows.where("region_type = 'footnote'"))).select("doc_id", "note_no", "body")


@register("detached_note_pairs", LINES.over(", p AS (SELECT doc_id, line_id AS pair_id, CAST(n AS VARCHAR) AS note_id, page_index AS lp, page_index * 10 + 8 AS place FROM t WHERE reading_order = 8), d AS (SELECT doc_id, line_id AS mark_id, CAST(n AS VARCHAR) AS note_id, page_index AS mp, page_index * 10 + 4 AS place FROM t WHERE reading_order = 4) SELECT d.doc_id, mark_id, pair_id FROM d JOIN p ON p.doc_id = d.doc_id AND p.note_id = d.note_id AND abs(lp - mp) <= 1 QUALIFY row_number() OVER (PARTITION BY d.doc_id, mark_id ORDER BY abs(lp - mp), p.place < d.place, abs(p.place - d.place), pair_id) = 1"))
def detached_note_pairs(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).withColumn("place", F.col("page_index") * 10 + F.col("reading_order")).withColumn("note_id", F.col("n").cast("string"))
    pairs = rows.where("reading_order = 8").select("doc_id", F.col("line_id").alias("pair_id"), "note_id", "page_index", "place", F.lit(False).alias("endnote"))
    return candidates.merge_detached(pairs, rows.where("reading_order = 4").select("doc_id", F.col("line_id").alias("mark_id"), "note_id", "page_index", "place"))


@register("line_zones", LINES.over("SELECT doc_id, CASE region_type WHEN 'footnote' THEN 'note' WHEN 'header' THEN 'header' WHEN 'heading' THEN 'title' ELSE 'body' END AS zone, count(*) AS n FROM t GROUP BY ALL"))
def line_zones(spark, sf_dir):
    return LINES.frame(spark, sf_dir).groupBy("doc_id", shapes.zone(F.col("region_type")).alias("zone")).agg(F.count("*").alias("n"))


@register("edge_folios", LINES.over("SELECT doc_id, page_index, line_id FROM t WHERE reading_order = 9"))
def edge_folios(spark, sf_dir):
    return LINES.frame(spark, sf_dir).where(shapes.edge_folio(F.col("region_type"), F.col("text"))).select("doc_id", "page_index", "line_id")


def _flows(region: str, first: str, second: str) -> str:
    """SQL: the first line, of a body region, goes on in the second."""
    tail, head, ended, opener = (shapes.PATTERNS[n].replace("'", "''") for n in ("hyphen_tail", "hyphen_head", "sentence_ended", "list_opener"))
    return f"coalesce({region} = 'body' AND ((regexp_matches(trim({first}), '{tail}') AND regexp_matches({second}, '{head}')) OR (NOT regexp_matches({second}, '{opener}') AND NOT regexp_matches(trim({first}), '{ended}') AND regexp_matches({second}, '^\\p{{Ll}}'))), FALSE)"


@register("flow_edges", LINES.over(", s AS (SELECT doc_id, page_index, reading_order, line_id, region_type, CASE WHEN k % 3 = 0 THEN lower(text) ELSE text END AS text FROM t), w AS (SELECT *, lag(text) OVER o AS p, lag(region_type) OVER o AS pr, lead(text) OVER o AS n, lead(region_type) OVER o AS nr FROM s WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY reading_order, line_id)) SELECT doc_id, page_index, line_id, " + _flows("pr", "p", "text") + " AS continues, " + _flows("nr", "text", "n") + " AS goes_on FROM w"))
def flow_edges(spark, sf_dir):
    return candidates.flow_edges(lines(spark, sf_dir).withColumn("text", F.when(F.col("k") % 3 == 0, F.lower("text")).otherwise(F.col("text"))))


@register("heading_candidates", LINES.over("SELECT doc_id, page_index, line_id, substr(text, 1, 1) AS value, 'GENERAL PART' AS title FROM t WHERE reading_order = 3"))
def heading_candidates(spark, sf_dir):
    return candidates.heading_candidates(lines(spark, sf_dir)).where("plausible").select("doc_id", "page_index", "line_id", "value", "title")


@register("contents_rows", LINES.over("SELECT doc_id, page_index, line_id, count(*) OVER (PARTITION BY doc_id, page_index) AS entries FROM t WHERE region_type NOT IN ('header', 'footer') QUALIFY count(*) OVER (PARTITION BY doc_id, page_index) >= 5"))
def contents_rows(spark, sf_dir):
    listed = lines(spark, sf_dir).withColumn("text", F.concat(F.lit("Part ..... "), F.col("n").cast("string")))
    return candidates.contents_rows(listed).select("doc_id", "page_index", "line_id", "entries")


@register("sandwiched_regions", LINES.over(""", r AS (SELECT doc_id, page_index, line_id AS region_id, CASE k % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'text' ELSE 'footnote' END AS label, x0, y0, (x0 + x1) / 2 >= 300 AS col, (y0 + y1) / 2 / 800 AS ratio FROM t),
  s AS (SELECT *, label = 'footnote' AS note, ratio >= 0.6 AS low FROM r), w AS (SELECT *, coalesce(note AND lag(note) OVER o, FALSE) AS two FROM s WINDOW o AS (PARTITION BY doc_id, page_index, col, low ORDER BY y0, x0, region_id)),
  v AS (SELECT *, coalesce(bool_or(two) OVER (PARTITION BY doc_id, page_index, col, low ORDER BY y0, x0, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS opened, coalesce(bool_or(note) OVER (PARTITION BY doc_id, page_index, col, low ORDER BY y0, x0, region_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), FALSE) AS later FROM w)
  SELECT doc_id, page_index, region_id, CASE WHEN note AND ratio <= 0.3 THEN 'text' WHEN low AND NOT note AND opened AND later AND label <> 'image' THEN 'footnote' ELSE label END AS label FROM v"""))
def sandwiched_regions(spark, sf_dir):
    label = F.when(F.col("k") % 5 == 0, "image").when(F.col("k") % 5 == 1, "text").otherwise("footnote")
    rows = lines(spark, sf_dir).select("doc_id", "page_index", F.col("line_id").alias("region_id"), label.alias("label"), "bbox", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return candidates.sandwiched(rows)


@register("order_decisions")
def order_decisions(spark, sf_dir):
    return candidates.order_decisions(lines(spark, sf_dir), pages(spark, sf_dir))
