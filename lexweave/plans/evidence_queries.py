"""Registered queries over typography, margins, table notes, markers and units, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import candidates, classify, insets, ladder, layout, lookup, statute, typography
from lexweave.plans.catalog import register
from lexweave.plans.synthetic import ACTS, LINES, act_lines, lines, pages

# --- Lines one under another, 13 high ---------------------------------------------------------------------

#: LINES with a leading of 13 and columns of nearly one width.
CLOSE = ", c AS (SELECT *, reading_order * 13 + 12 AS top, reading_order * 13 + 24 AS low, (k % 3) * 10 AS lx, 540 + (k % 6) * 10 AS rx FROM t)"


def _close(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir)
    at = F.col("reading_order") * 13.0
    box = F.struct(((F.col("k") % 3) * 10).cast("double").alias("x0"), (at + 12).alias("y0"), (F.col("k") % 6 * 10 + 540).cast("double").alias("x1"), (at + 24).alias("y1"))
    return rows.withColumn("bbox", box).withColumn("exclude_from_body", F.lit(False))


@register("bold_shares", LINES.over(", s AS (SELECT doc_id, line_id, length(substr(text, 1, CAST(k % 10 AS INTEGER))) AS a, k % 2 = 1 OR k % 3 = 0 AS bold FROM t) SELECT doc_id, line_id, round(CASE WHEN bold THEN a ELSE 0 END / (a + 11), 6) AS share FROM s"))
def bold_shares(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir)
    first = F.struct(F.expr("substring(text, 1, int(k % 10))").alias("text"), (F.col("k") % 2 * 16).cast("int").alias("flags"), F.when(F.col("k") % 3 == 0, "Times-BOLD").otherwise("Times").alias("font"))
    second = F.struct(F.lit("plain words").alias("text"), F.lit(0).alias("flags"), F.lit("Times").alias("font"))
    return rows.select("doc_id", "line_id", F.round(typography.bold_share(F.array(first, second)), 6).alias("share"))


@register("raised_labels", LINES.over(", s AS (SELECT doc_id, page_index, line_id, CAST(n AS VARCHAR) AS label, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 10 END AS size, k % 5 = 0 AS sup, k % 2 * 0.5 AS lift FROM t), r AS (SELECT *, sup OR size <= 7.5 OR (size * 1.25 <= 10 AND lift >= 0.25) AS raised FROM s) SELECT doc_id, page_index, line_id, label, raised, raised OR size <= 9 AS typographic FROM r"))
def raised_labels(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("text", F.concat(F.col("n").cast("string"), F.lit(". Note text")))
    up = (F.col("y1") - F.col("y0")) * (F.col("k") % 2) * 0.5
    size = F.when(F.col("k") % 3 == 0, 5.0).when(F.col("k") % 3 == 1, 8.0).otherwise(10.0)
    span = lambda a, b, size, sup, box: F.struct(F.substring("text", a + 1, b - a).alias("text"), size.alias("size"), sup.alias("superscript"), F.lit(a).alias("start"), F.lit(b).alias("end"), box.alias("bbox"))
    label = span(0, 1, size, F.col("k") % 5 == 0, F.struct("x0", "y0", "x1", (F.col("y1") - up).alias("y1")))
    rest = span(1, 12, F.lit(10.0), F.lit(False), F.struct("x0", "y0", "x1", "y1"))
    return typography.raised_labels(rows.withColumn("spans", F.array(label, rest)).withColumn("body_size", F.lit(12.0)))


@register(
    "wrapped_references",
    LINES.over(
        CLOSE + """, s AS (SELECT doc_id, page_index, line_id, reading_order, top, low, lx, rx, 10 + k % 2 AS size, CASE k % 4 WHEN 0 THEN 'under s.' WHEN 1 THEN 'see  arts ' WHEN 2 THEN 'the acts' ELSE 'ch' END AS words FROM c),
        m AS (SELECT s.doc_id, s.page_index, s.line_id, a.line_id AS above_id, a.words FROM s JOIN s a ON a.doc_id = s.doc_id AND a.page_index = s.page_index AND a.line_id <> s.line_id AND abs(a.size - s.size) <= 0.5 AND a.low <= s.top + (s.low - s.top) * 0.5 AND s.top - a.low < (s.low - s.top) * 0.6 AND a.lx < s.rx AND s.lx < a.rx
              QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.page_index, s.line_id ORDER BY a.low DESC, a.reading_order DESC) = 1)
        SELECT doc_id, page_index, line_id, above_id FROM m WHERE regexp_matches(words, '(^|\\s)(c|ch|s|ss|art|arts)\\.*\\s*$')"""
    ),
)
def wrapped_references(spark, sf_dir):
    words = F.when(F.col("k") % 4 == 0, "under s.").when(F.col("k") % 4 == 1, "see  arts ").when(F.col("k") % 4 == 2, "the acts").otherwise("ch")
    return typography.wrapped_references(_close(spark, sf_dir).withColumns({"text": words, "size": (F.col("k") % 2 + 10).cast("double")}))


@register(
    "prose_continuations",
    LINES.over(
        CLOSE + """, b AS (SELECT * FROM c WHERE region_type = 'body'),
        e AS (SELECT b.doc_id, b.page_index, b.line_id, least(min(o.lx), min(b.lx)) AS l, greatest(max(o.rx), max(b.rx)) AS r FROM b JOIN b o ON o.doc_id = b.doc_id AND o.page_index = b.page_index AND o.lx < b.rx AND b.lx < o.rx GROUP BY ALL),
        m AS (SELECT c.doc_id, c.page_index, c.line_id, c.top, a.line_id AS above_id, a.low, a.rx, rtrim(a.text) AS words FROM c JOIN b a ON a.doc_id = c.doc_id AND a.page_index = c.page_index AND a.line_id <> c.line_id AND a.low <= c.top + 3 AND a.lx < c.rx AND c.lx < a.rx
              QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.page_index, c.line_id ORDER BY a.low DESC, a.reading_order DESC) = 1)
        SELECT m.doc_id, m.page_index, m.line_id, above_id FROM m JOIN e ON e.doc_id = m.doc_id AND e.page_index = m.page_index AND e.line_id = m.above_id
        WHERE rx >= r - (r - l) * 0.1 AND top - low < 6 AND NOT regexp_matches(words, '[.!?]["'')\\]]*$') AND NOT regexp_matches(words, '[:”"]$')"""
    ),
)
def prose_continuations(spark, sf_dir):
    return typography.prose_continuations(_close(spark, sf_dir))


@register(
    "heading_evidence",
    LINES.over(
        CLOSE + """, w AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'GENErAL PARt' ELSE text END AS words, lag(region_type) OVER o AS pr, lag(lx) OVER o AS px, lead(region_type) OVER o AS nr, lead(lx) OVER o AS nx FROM c WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY reading_order, line_id))
        SELECT doc_id, page_index, line_id, coalesce(pr = 'body' AND abs(lx - px) <= 10, FALSE) AND coalesce(nr = 'body' AND abs(lx - nx) <= 10, FALSE) AS between_body,
               regexp_matches(words, '[A-Z]') AND regexp_matches(words, '[a-z]') AND length(regexp_replace(words, '[^A-Z]', '', 'g')) / length(regexp_replace(words, '[^A-Za-z]', '', 'g')) >= 0.65 AS warble FROM w"""
    ),
)
def heading_evidence(spark, sf_dir):
    rows = _close(spark, sf_dir).withColumn("text", F.when(F.col("k") % 5 == 0, "GENErAL PARt").otherwise(F.col("text")))
    return typography.heading_evidence(rows)


# --- Margins, tables, detections ----------------------------------------------------------------------------


@register(
    "margin_models",
    LINES.over(
        """, c AS (SELECT *, reading_order * 13 + 12 AS top, reading_order * 13 + 24 AS low, k % 3 = 0 AS label, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 10 ELSE 570 END ELSE 100 END AS a, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 30 ELSE 590 END ELSE 500 END AS b FROM t),
        l AS (SELECT doc_id, page_index, k % 2 <> 0 AS side, count(*) AS n, min(a) AS nl, max(b) AS nr, min(top) AS t0, max(low) AS b0 FROM c WHERE label GROUP BY ALL),
        p AS (SELECT l.*, count(*) AS prose, min(a) AS bl, max(b) AS br FROM l JOIN c ON c.doc_id = l.doc_id AND c.page_index = l.page_index AND b - a >= 150 AND region_type NOT IN ('header', 'footer') AND low >= t0 AND top <= b0 GROUP BY ALL),
        m AS (SELECT *, CASE WHEN nr + 15 <= bl THEN (nr + bl) / 2 WHEN br + 15 <= nl THEN (br + nl) / 2 END AS split_x FROM p WHERE prose >= 3)
        SELECT doc_id, page_index, 'margin_column' AS kind, CAST(split_x AS DOUBLE) AS split_x, CASE WHEN side THEN prose ELSE n END AS left_lines, CASE WHEN side THEN n ELSE prose END AS right_lines FROM m WHERE split_x IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n DESC, side DESC) = 1"""
    ),
)
def margin_models(spark, sf_dir):
    label = F.col("k") % 3 == 0
    left = F.col("k") % 2 == 0
    at = F.col("reading_order") * 13.0
    end = lambda a, b, c: F.when(label, F.when(left, F.lit(a)).otherwise(F.lit(b))).otherwise(F.lit(c))
    rows = _close(spark, sf_dir).withColumns({"text": F.when(label, "4. margin note").otherwise(F.col("text")), "bbox": F.struct(end(10.0, 570.0, 100.0).alias("x0"), (at + 12).alias("y0"), end(30.0, 590.0, 500.0).alias("x1"), (at + 24).alias("y1")), "size": F.lit(10.0)})
    return layout.margin_models(rows, rows.where(label), pages(spark, sf_dir).withColumn("body_size", F.lit(10.0)))


@register(
    "table_notes",
    LINES.over(
        """, c AS (SELECT doc_id, page_index, line_id, reading_order, reading_order * 13 + 12 AS top, reading_order * 13 + 24 AS low, reading_order <= 3 AS in_table, reading_order <= 4 AND k % 2 = 0 AS in_cell, k % 4 AS kind FROM t),
        a AS (SELECT doc_id, page_index, line_id AS anchor, top AS at_top, low AS at_low FROM c WHERE kind = 0 AND ((NOT in_table AND in_cell) OR (top > 76 AND top <= 76 + 36))),
        f AS (SELECT c.*, anchor, at_low FROM c JOIN a ON a.doc_id = c.doc_id AND a.page_index = c.page_index AND c.line_id <> anchor AND top >= at_top),
        g AS (SELECT *, greatest(at_low, coalesce(max(low) OVER (PARTITION BY doc_id, page_index, anchor ORDER BY top, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), at_low)) AS reached FROM f),
        h AS (SELECT *, max(CASE WHEN top - reached > 19.2 OR in_cell OR kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index, anchor ORDER BY top, line_id) AS ended FROM g)
        SELECT doc_id, page_index, line_id FROM h WHERE ended = 0 UNION SELECT doc_id, page_index, anchor FROM a"""
    ),
)
def table_notes(spark, sf_dir):
    kind = F.col("k") % 4
    rows = _close(spark, sf_dir).withColumns({"text": F.when(kind == 0, "* Note on this row").when(kind == 1, "Table 3").otherwise("goes on here"), "in_table": F.col("reading_order") <= 3, "in_cell": (F.col("reading_order") <= 4) & (F.col("k") % 2 == 0)})
    tables = pages(spark, sf_dir).select("doc_id", "page_index", F.lit(76.0).alias("bottom"), F.lit(12.0).alias("line_height"))
    return layout.table_notes(rows, tables)


@register(
    "class_detections",
    LINES.over(
        """, d AS (SELECT doc_id, page_index, reading_order AS query, CAST(k % 2 AS INTEGER) AS label, (k % 50) / 50.0 AS score, x0, x1, y0 / 10 AS y0, y1 / 10 + 10 AS y1 FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, label ORDER BY score DESC, query) AS place FROM d WHERE score > 0.2),
        i AS (SELECT a.doc_id, a.page_index, a.label, a.place AS p, b.place AS q, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS s, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS w FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.label = b.label AND a.place < b.place WHERE b.place <= 3),
        o AS (SELECT doc_id, page_index, label, coalesce(bool_or(p = 1 AND q = 2), FALSE) AS o12, coalesce(bool_or(p = 1 AND q = 3), FALSE) AS o13, coalesce(bool_or(p = 2 AND q = 3), FALSE) AS o23 FROM i WHERE s / (w - s) > 0.3 GROUP BY ALL),
        k AS (SELECT r.* FROM r LEFT JOIN o USING (doc_id, page_index, label) WHERE place = 1 OR (place = 2 AND NOT coalesce(o12, FALSE)) OR (place = 3 AND NOT coalesce(o13, FALSE) AND (coalesce(o12, FALSE) OR NOT coalesce(o23, FALSE))))
        SELECT doc_id, page_index, CAST(row_number() OVER w - 1 AS INTEGER) AS rank, CAST(query AS INTEGER) AS query, label, CAST(score AS DOUBLE) AS score FROM k WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY score DESC, label, query) QUALIFY row_number() OVER w <= 4"""
    ),
)
def class_detections(spark, sf_dir):
    boxes = LINES.frame(spark, sf_dir).select("doc_id", "page_index", F.col("reading_order").alias("query"), (F.col("k") % 2).cast("int").alias("label"), (F.col("k") % 50 / 50.0).alias("score"), F.struct("x0", (F.col("y0") / 10).alias("y0"), "x1", (F.col("y1") / 10 + 10).alias("y1")).alias("bbox"))
    return layout.class_detections(boxes, 3, 4, 0.2, 0.3)


@register("numbered_margins", LINES.over(", c AS (SELECT doc_id, floor(page_index / 2) AS page_index, (page_index % 2) * 10 + reading_order + 1 AS v, k % 9 <> 0 AS kept FROM t) SELECT doc_id, CAST(page_index AS INTEGER) AS page_index FROM c WHERE kept AND v <= 15 GROUP BY ALL HAVING count(DISTINCT v) >= 15"))
def numbered_margins(spark, sf_dir):
    number = (F.col("page_index") % 2) * 10 + F.col("reading_order") + 1
    rows = LINES.frame(spark, sf_dir).where("k % 9 <> 0").select("doc_id", F.floor(F.col("page_index") / 2).cast("int").alias("page_index"), number.cast("string").alias("text"), F.struct((F.lit(20.0) + F.col("k") % 3).alias("x0")).alias("bbox"))
    return layout.transcript_pages(rows, rows.select("doc_id", "page_index").distinct().withColumn("width", F.lit(600.0)))


@register(
    "index_pages",
    LINES.over(
        """, w AS (SELECT doc_id, page_index, reading_order, line_id, k % 3 = 0 AS entry, CASE WHEN k % 3 = 0 THEN chr(CAST(97 + (reading_order * 2 + k % 5) % 26 AS INTEGER)) || 'word' END AS word FROM t),
        s AS (SELECT *, word >= last_value(word IGNORE NULLS) OVER (PARTITION BY doc_id, page_index ORDER BY reading_order, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM w)
        SELECT doc_id, page_index, count(word) AS headwords, count(*) FILTER (up) AS ups FROM s GROUP BY ALL HAVING count(word) >= 5 AND count(*) FILTER (up) >= 0.8 * (count(word) - 1)"""
    ),
)
def index_pages(spark, sf_dir):
    word = F.concat(F.char((97 + (F.col("reading_order") * 2 + F.col("k") % 5) % 26).cast("int")), F.lit("word"))
    rows = LINES.frame(spark, sf_dir).withColumn("text", F.when(F.col("k") % 3 == 0, F.concat(word, F.lit(" 12:7"))).otherwise("no entry here"))
    return layout.index_pages(rows).select("doc_id", "page_index", "headwords", "ups")


@register(
    "block_quotes",
    LINES.over(
        """, r AS (SELECT doc_id, page_index, line_id AS region_id, CASE WHEN reading_order = 9 THEN 'footnote' ELSE 'text' END AS label, 60.0 + CASE WHEN k % 3 = 0 THEN 60 ELSE k % 2 * 4 END AS a, 540.0 - CASE WHEN k % 3 = 0 THEN 50 ELSE 0 END AS b, reading_order * 13 + 12.0 AS top, reading_order * 13 + 24.0 AS low, (k % 10) / 10.0 AS score, n % 3 + 1 AS lines FROM t),
        x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY top, (a + b) / 2, a, region_id) AS place, count(*) OVER (PARTITION BY doc_id, page_index) AS nrows FROM r WHERE label = 'text'),
        f AS (SELECT doc_id, page_index, a AS na, b AS nb, top AS ntop FROM r WHERE label = 'footnote'),
        p AS (SELECT x.*, coalesce(score <= 0.25 AND ntop - low BETWEEN -12 AND 90 AND (least(b, nb) - greatest(a, na)) / least(b - a, nb - na) >= 0.08 AND ntop - low <= 10, FALSE) AS spill FROM x LEFT JOIN f USING (doc_id, page_index)),
        e AS (SELECT doc_id, page_index, list_sort(list(a)) AS la, list_sort(list(b)) AS lb, list_sort(list(b - a)) AS lw FROM p GROUP BY ALL HAVING count(*) >= 3),
        q AS (SELECT p.*, CASE WHEN spill OR la IS NULL THEN 0 ELSE 0.5 * greatest(0, least(1, (lw[1 + CAST(round_even((len(lw) - 1) * 0.9, 0) AS INTEGER)] - (b - a)) / greatest(lw[1 + CAST(round_even((len(lw) - 1) * 0.9, 0) AS INTEGER)] * 0.18, 22)))
             + 0.35 * greatest(0, least(1, (a - la[1 + CAST(round_even((len(la) - 1) * 0.1, 0) AS INTEGER)]) / 22)) + 0.15 * greatest(0, least(1, (lb[1 + CAST(round_even((len(lb) - 1) * 0.9, 0) AS INTEGER)] - b) / 22)) END AS inset_score FROM p LEFT JOIN e USING (doc_id, page_index)),
        s AS (SELECT *, inset_score >= 0.45 AS inset FROM q),
        w AS (SELECT *, coalesce(NOT lag(inset) OVER o, FALSE) AS before, coalesce(NOT lead(inset) OVER o, FALSE) AS after FROM s WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY place)),
        m AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, page_index ORDER BY place) AS island FROM w WHERE inset),
        g AS (SELECT doc_id, page_index, island, median(inset_score) + least((count(*) - 1) * 0.025, 0.1) AS score, sum(lines) AS lines, arg_min(before, place) AS before, arg_max(after, place) AS after, min(a) AS a, max(b) AS b, max(low) AS low FROM m GROUP BY ALL),
        h AS (SELECT g.*, coalesce(before AND ntop - low BETWEEN -12 AND 90 AND (least(b, nb) - greatest(a, na)) / least(b - a, nb - na) >= 0.08, FALSE) AS edge FROM g LEFT JOIN f USING (doc_id, page_index)),
        z AS (SELECT doc_id, page_index, island FROM h WHERE lines >= 2 AND NOT (lines <= 2 AND (score < 0.8 OR NOT (before AND after))) AND score >= CASE WHEN (before AND after) OR edge THEN 0.45 ELSE 0.68 END AND ((before AND after) OR edge OR ((before OR after) AND score >= 0.76 AND lines >= 3))),
        y AS (SELECT m.doc_id, m.page_index, region_id FROM m JOIN z USING (doc_id, page_index, island))
        SELECT s.doc_id, s.page_index, s.region_id, CASE WHEN nrows < 3 THEN 'text' WHEN spill THEN 'footnote' WHEN y.region_id IS NOT NULL THEN 'block_quote' ELSE 'text' END AS label FROM s LEFT JOIN y ON y.doc_id = s.doc_id AND y.page_index = s.page_index AND y.region_id = s.region_id"""
    ),
)
def block_quotes(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir)
    at = F.col("reading_order") * 13.0
    far = F.col("k") % 3 == 0
    left = F.when(far, 120.0).otherwise((F.col("k") % 2 * 4 + 60).cast("double"))
    box = F.struct(left.alias("x0"), (at + 12).alias("y0"), F.when(far, 490.0).otherwise(540.0).alias("x1"), (at + 24).alias("y1"))
    label = F.when(F.col("reading_order") == 9, "footnote").otherwise("text")
    regions = rows.select("doc_id", "page_index", F.col("line_id").alias("region_id"), label.alias("label"), box.alias("bbox"), (F.col("k") % 10 / 10.0).alias("score"), (F.col("n") % 3 + 1).alias("line_count"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return insets.block_quotes(regions)


@register(
    "numeric_outlines",
    LINES.over(
        """, o AS (SELECT doc_id, page_index, line_id, reading_order AS ro, CASE WHEN page_index % 3 = 1 THEN 9 - reading_order ELSE reading_order END AS v, 50 + CASE WHEN page_index % 4 = 2 THEN reading_order * 5 ELSE 0 END AS x FROM t),
        c AS (SELECT *, floor(v / 3) + 1 AS major, CAST(v AS INTEGER) % 3 AS minor FROM o),
        g AS (SELECT doc_id, page_index FROM c GROUP BY ALL HAVING count(*) >= 4 AND count(*) FILTER (minor > 0) >= 2 AND page_index % 3 <> 1 AND max(CASE WHEN minor = 0 THEN x END) - min(CASE WHEN minor = 0 THEN x END) <= 9 AND max(CASE WHEN minor > 0 THEN x END) - min(CASE WHEN minor > 0 THEN x END) <= 9)
        SELECT c.doc_id, c.page_index, c.line_id, 0 AS start, CASE WHEN minor = 0 THEN 2 ELSE 3 END AS "end", CASE WHEN minor = 0 THEN 1 ELSE 2 END AS depth FROM c JOIN g USING (doc_id, page_index)"""
    ),
)
def numeric_outlines(spark, sf_dir):
    v = F.when(F.col("page_index") % 3 == 1, 9 - F.col("reading_order")).otherwise(F.col("reading_order"))
    major, minor = (F.floor(v / 3) + 1).cast("string"), v % 3
    text = F.when(minor == 0, F.concat(major, F.lit(". General Part"))).otherwise(F.concat(major, F.lit("."), minor.cast("string"), F.lit(" Special Part")))
    x = F.lit(50.0) + F.when(F.col("page_index") % 4 == 2, F.col("reading_order") * 5).otherwise(0)
    rows = LINES.frame(spark, sf_dir).withColumns({"text": text, "x0": x, "page_width": F.lit(600.0)})
    return ladder.numeric_outlines(rows)


# --- Markers, labels and evidence ------------------------------------------------------------------------------


@register(
    "marker_runs",
    LINES.over(
        """, s AS (SELECT doc_id, line_id, CAST(k AS VARCHAR) AS d, length(CAST(k AS VARCHAR)) AS m, CAST(n AS VARCHAR) AS e FROM t)
        SELECT doc_id, line_id, 'digits' AS kind, 1 AS start, 1 + m AS "end", d AS value FROM s UNION ALL
        SELECT doc_id, line_id, 'raised', 1 + m, 5 + m, '⁰¹²³' FROM s UNION ALL SELECT doc_id, line_id, 'raised', 5 + m, 6 + m, '⁴' FROM s UNION ALL
        SELECT doc_id, line_id, 'symbols', 7 + m, 15 + m, '*†‡§*†‡§' FROM s UNION ALL SELECT doc_id, line_id, 'symbols', 15 + m, 16 + m, '*' FROM s UNION ALL
        SELECT doc_id, line_id, 'digits', 26 + m, 27 + m, e FROM s"""
    ),
)
def marker_runs(spark, sf_dir):
    text = F.concat(F.lit("a"), F.col("k").cast("string"), F.lit("⁰¹²³⁴ *†‡§*†‡§* 12345678 "), F.col("n").cast("string"), F.lit("b"))
    return LINES.frame(spark, sf_dir).select("doc_id", "line_id", F.explode(candidates.runs(text)).alias("r")).select("doc_id", "line_id", "r.*")


@register("observed_markers", LINES.over("SELECT doc_id, line_id, CASE k % 4 WHEN 0 THEN n || '' WHEN 1 THEN '1' || n WHEN 2 THEN '*' || n ELSE 'a' || n END AS observed, CAST(CASE WHEN k % 2 = 0 THEN 0.123 ELSE 0.556 END AS DOUBLE) AS confidence FROM t"))
def observed_markers(spark, sf_dir):
    n = F.col("n").cast("string")
    value = F.when(F.col("k") % 4 == 0, F.concat(F.lit(" ( "), n, F.lit(" ).: "))).when(F.col("k") % 4 == 1, F.concat(F.lit("¹"), n)).when(F.col("k") % 4 == 2, F.concat(F.lit("[∗"), n, F.lit("]"))).otherwise(F.concat(F.lit("a "), n, F.lit("."))) 
    score = F.when(F.col("k") % 2 == 0, 0.12345).otherwise(0.5555001)
    return LINES.frame(spark, sf_dir).select("doc_id", "line_id", candidates.observed_marker(value).alias("observed"), candidates.marker_confidence(score).alias("confidence"))


@register(
    "labels_without_references",
    LINES.over(
        """, l AS (SELECT doc_id, page_index % 2 AS chain, page_index * 10 + reading_order AS place, line_id AS label_id, CAST(n AS INTEGER) AS value, page_index, k % 3 AS score, region_type IN ('footnote', 'heading') AS note FROM t),
        s AS (SELECT *, lag(value) OVER w AS pv, lag(page_index) OVER w AS pp, lead(value) OVER w AS nv, lead(page_index) OVER w AS np FROM l WINDOW w AS (PARTITION BY doc_id, chain ORDER BY place, label_id))
        SELECT doc_id, CAST(chain AS INTEGER) AS chain, label_id, value FROM s WHERE note AND (score >= 1.5 OR coalesce(abs(value - pv) = 1 AND abs(page_index - pp) <= 1, FALSE) OR coalesce(abs(value - nv) = 1 AND abs(page_index - np) <= 1, FALSE))"""
    ),
)
def labels_without_references(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).select("doc_id", (F.col("page_index") % 2).cast("int").alias("chain"), (F.col("page_index") * 10 + F.col("reading_order")).alias("place"), F.col("line_id").alias("label_id"), F.col("n").alias("value"), "page_index", F.when(F.col("region_type").isin("footnote", "heading"), "note").otherwise("body").alias("zone"), (F.col("k") % 3).cast("double").alias("score"))
    return candidates.kept_labels(rows)


@register("candidate_observations", LINES.over(", f AS (SELECT doc_id, page_index AS candidate_id, k % 3 AS kind, region_type AS source, n AS value, min(reading_order) AS seq FROM t GROUP BY ALL) SELECT doc_id, candidate_id, string_agg(kind || ':' || source || ':' || value, ' ' ORDER BY seq) AS observed FROM f GROUP BY ALL"))
def candidate_observations(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).select("doc_id", F.col("page_index").alias("candidate_id"), F.col("reading_order").alias("seq"), (F.col("k") % 3).cast("string").alias("kind"), F.col("region_type").alias("source"), F.col("n").cast("string").alias("value"))
    told = candidates.observations(rows)
    return told.select("doc_id", "candidate_id", F.array_join(F.transform("observations", lambda o: F.concat_ws(":", o["kind"], o["source"], o["value"])), " ").alias("observed"))


AUDIT = ", l AS (SELECT doc_id, line_id AS pair_id, k % 4 AS want, page_index FROM t WHERE reading_order = 8), m AS (SELECT doc_id, line_id AS ref_id, k % 4 AS have, page_index FROM t WHERE reading_order = 4), p AS (SELECT l.doc_id, pair_id, ref_id FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.page_index = l.page_index AND have = want)"


def _audit(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).withColumn("want", F.col("k") % 4)
    label = rows.where("reading_order = 8").select("doc_id", "page_index", "want", F.col("line_id").alias("pair_id"), F.col("line_id").alias("label_id"), F.lit("(4)").alias("label_text"), F.lit(2.0).alias("label_score"))
    mark = rows.where("reading_order = 4")
    pairs = label.join(mark.select("doc_id", "page_index", "want", F.col("line_id").alias("ref_id"), F.lit(1.0).alias("ref_score")), ["doc_id", "page_index", "want"], "left")
    return candidates.marker_audit(pairs, mark.select("doc_id", F.col("line_id").alias("ref_id"), F.lit(" ⁴ ").alias("text"), F.lit(0.33349).alias("score")))


@register("marker_audit", LINES.over(AUDIT + " SELECT doc_id, 'label' AS role, CASE WHEN ref_id IS NULL THEN 'label_only' ELSE 'paired' END AS status, pair_id AS marker_id, pair_id, '4' AS observed, CAST(2 AS DOUBLE) AS confidence FROM p UNION ALL SELECT m.doc_id, 'reference', CASE WHEN p.pair_id IS NULL THEN 'unpaired' ELSE 'paired' END, m.ref_id, p.pair_id, '4', CAST(0.333 AS DOUBLE) FROM m LEFT JOIN p ON p.doc_id = m.doc_id AND p.ref_id = m.ref_id"))
def marker_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


@register("marker_audit_counts", LINES.over(AUDIT + " SELECT doc_id, role, status, count(*) AS n FROM (SELECT doc_id, 'label' AS role, CASE WHEN ref_id IS NULL THEN 'label_only' ELSE 'paired' END AS status FROM p UNION ALL SELECT m.doc_id, 'reference', CASE WHEN p.pair_id IS NULL THEN 'unpaired' ELSE 'paired' END FROM m LEFT JOIN p ON p.doc_id = m.doc_id AND p.ref_id = m.ref_id) GROUP BY ALL"))
def marker_audit_counts(spark, sf_dir):
    return candidates.audit_counts(_audit(spark, sf_dir))


@register("endnote_chains", LINES.over(", c AS (SELECT doc_id, k % 6 AS chain, page_index FROM t), l AS (SELECT doc_id, max(page_index) AS last FROM t GROUP BY doc_id) SELECT doc_id, CAST(chain AS BIGINT) AS chain, count(*) AS labels, count(*) >= 4 AND last > 1 AND count(*) FILTER (page_index > 0.75 * last) / count(*) >= 0.7 AS endnotes FROM c JOIN l USING (doc_id) WHERE page_index * 5 >= chain * last GROUP BY doc_id, chain, last"))
def endnote_chains(spark, sf_dir):
    p = pages(spark, sf_dir)
    last = p.groupBy("doc_id").agg(F.max("page_index").alias("top"))
    chains = LINES.frame(spark, sf_dir).select("doc_id", (F.col("k") % 6).alias("chain"), "page_index").join(last, "doc_id").where(F.col("page_index") * 5 >= F.col("chain") * F.col("top"))
    return candidates.endnote_chains(chains.drop("top"), p).select("doc_id", "chain", "labels", "endnotes")


@register("suspect_heading_families", LINES.over("SELECT doc_id, 'numeric_' || k % 3 AS family, count(*) AS n, CAST(max(k % 40) AS INTEGER) AS max_value, count(DISTINCT n % 2) AS levels, max(k % 40) >= " + str(ladder.SUSPECT_VALUE) + " AND count(DISTINCT n % 2) = 1 AS footnote_suspect FROM t WHERE k % 3 <> 0 OR n % 2 = 0 GROUP BY doc_id, k % 3"))
def suspect_heading_families(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).select("doc_id", F.concat(F.lit("numeric_"), (F.col("k") % 3).cast("string")).alias("family"), (F.col("k") % 40).cast("int").alias("value"), F.when((F.col("k") % 3 != 0) | (F.col("n") % 2 == 0), F.col("n") % 2).alias("level"))
    return ladder.suspect_families(rows)


# --- Units ---------------------------------------------------------------------------------------------------


def _paged(spark, sf_dir):
    p = pages(spark, sf_dir).select("doc_id", "page_index", "page_number")
    return p.withColumns({"page_id": F.when(F.col("page_index") % 2 == 0, F.format_string("pg-%d", F.col("page_number"))).otherwise(""), "text_quality": (F.col("page_index") % 5) * 0.3, "source": F.when(F.col("page_index") % 3 == 0, "").otherwise("native"), "text": F.concat(F.lit("page "), F.col("page_number").cast("string"))})


@register("page_units", LINES.over(", p AS (SELECT DISTINCT doc_id, page_index, page_number FROM t) SELECT doc_id, CASE WHEN page_index % 2 = 0 THEN 'pg-' ELSE 'page-' END || page_number AS unit_id, '[page ' || page_number || ']' AS locator, 'page ' || page_number AS text, round(least(1, (page_index % 5) * 0.3), 6) AS confidence, CASE WHEN page_index % 3 = 0 THEN 'unknown' ELSE 'native' END AS provenance FROM p"))
def page_units(spark, sf_dir):
    return lookup.page_units(_paged(spark, sf_dir)).select("doc_id", "unit_id", "locator", "text", F.round("confidence", 6).alias("confidence"), "provenance")


@register("paragraph_units", LINES.over("SELECT doc_id, line_id AS unit_id, 'paragraph ' || (page_index * 10 + reading_order) AS locator, CASE WHEN page_index % 4 = 3 THEN -1 ELSE page_number END AS page, CASE WHEN page_index % 4 = 3 THEN NULL ELSE round(least(1, (page_index % 5) * 0.3), 6) END AS confidence, CASE WHEN page_index % 4 = 3 THEN 'unavailable' ELSE 'page_text_quality' END AS basis, 'legalpdf:' || CASE WHEN region_type IN ('body', 'heading') THEN region_type ELSE 'unknown' END AS provenance FROM t"))
def paragraph_units(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).select("doc_id", F.col("line_id").alias("paragraph_id"), (F.col("page_index") * 10 + F.col("reading_order")).alias("ordinal"), "page_index", "region_type", "text")
    units = lookup.paragraph_units(rows, _paged(spark, sf_dir).where("page_index % 4 <> 3"))
    return units.select("doc_id", "unit_id", "locator", F.coalesce(F.get("pages", F.lit(0)), F.lit(-1)).alias("page"), F.round("confidence", 6).alias("confidence"), "basis", "provenance")


@register("footnote_units", LINES.over("SELECT doc_id, line_id AS unit_id, 'footnote ' || n AS locator, 'a note' AS text, CASE WHEN k % 3 = 0 THEN page_number || '' WHEN k % 3 = 1 THEN page_number || ',' || (page_number + 1) ELSE (page_number + 1) || '' END AS pages, CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 1 END AS DOUBLE) AS confidence FROM t WHERE reading_order = 8"))
def footnote_units(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).where("reading_order = 8")
    k = F.col("k") % 3
    notes = rows.select("doc_id", F.col("line_id").alias("pair_id"), F.col("n").cast("string").alias("label"), F.lit("  a note ").alias("body"), F.when(k < 2, F.col("page_number")).alias("reference_page"), F.when(k == 0, F.array("page_number")).otherwise(F.array(F.col("page_number") + 1)).alias("body_pages"), ((F.col("k") % 4) * 0.5).alias("confidence_in"), F.lit("").alias("provenance"), F.lit("s").alias("sentence"), F.lit("p").alias("passage"))
    units = lookup.footnote_units(notes.withColumn("confidence", F.when(F.col("confidence_in") == 0, -1.0).otherwise(F.col("confidence_in"))))
    return units.select("doc_id", "unit_id", "locator", "text", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "confidence")


@register("section_units", LINES.over(", s AS (SELECT doc_id, page_index AS seq, [page_index, page_index + 1, page_index] AS ps, k FROM t WHERE reading_order = 3), e AS (SELECT doc_id, seq, k, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM s), q AS (SELECT DISTINCT doc_id, page_index, page_number, least(1, (page_index % 5) * 0.3) AS quality FROM t), j AS (SELECT e.doc_id, seq, k, page_number, quality FROM e JOIN q ON q.doc_id = e.doc_id AND q.page_index = e.p) SELECT doc_id, CASE WHEN k % 2 = 0 THEN 's' || seq ELSE 'section-' || seq END AS unit_id, CASE WHEN k % 2 = 0 THEN 's' || seq ELSE 'Part ' || seq END AS locator, count(DISTINCT page_number) AS pages, round(min(quality), 6) AS confidence FROM j GROUP BY doc_id, seq, k"))
def section_units(spark, sf_dir):
    rows = LINES.frame(spark, sf_dir).where("reading_order = 3")
    even = F.col("k") % 2 == 0
    seq = F.col("page_index")
    sections = rows.select("doc_id", seq.alias("seq"), F.when(even, F.concat(F.lit("s"), seq.cast("string"))).otherwise("").alias("section_id"), F.when(~even, F.concat(F.lit(" Part "), seq.cast("string"))).alias("label"), F.array(seq, seq + 1, seq).alias("page_indexes"), "text")
    units = lookup.section_units(sections, _paged(spark, sf_dir))
    return units.select("doc_id", "unit_id", "locator", F.size("pages").cast("bigint").alias("pages"), F.round("confidence", 6).alias("confidence"))


@register("compact_note_lines", LINES.over("SELECT doc_id, line_id FROM t WHERE k % 3 <> 2"))
def compact_note_lines(spark, sf_dir):
    text = F.when(F.col("k") % 3 == 0, F.concat(F.col("n").cast("string"), F.lit(". See it"))).when(F.col("k") % 3 == 1, "† Noted").otherwise(F.concat(F.col("n").cast("string"), F.lit(") 12 ab")))
    return LINES.frame(spark, sf_dir).where(T.compact_note_line(text)).select("doc_id", "line_id")


# --- Whole Acts --------------------------------------------------------------------------------------------------


def _nodes() -> str:
    """SQL: every provision that an Act of ACTS has, by the kind of its sections."""
    sec = "'sec_' || seq"
    row = lambda eid, kind, num, parent, depth, heading, text, where: f"SELECT doc_id, {eid} AS eid, '{kind}' AS kind, {num} AS num, {parent} AS parent_eid, {depth} AS depth, {heading} AS heading, {text} AS text FROM t WHERE {where}"
    null = "CAST(NULL AS VARCHAR)"
    parts = [
        row("'act_preamble'", "chapter", "'PREAMBLE'", null, 0, null, "'THE LEVY OF ITEMS ACT, ' || (2000 + doc_id % 20) || ' Act 12 of ' || (2000 + doc_id % 20)", "seq = 1"),
        row("'chapter_1'", "chapter", "'I'", null, 0, "'PRELIMINARY'", "''", "seq = 1"),
        row("'chapter_2'", "chapter", "'II'", null, 0, "'RATES'", "''", "seq = 4"),
        row(sec, "section", "CAST(seq AS VARCHAR)", null, 0, "CASE kind WHEN 0 THEN 'Levy' WHEN 1 THEN 'Rates' WHEN 2 THEN 'Meaning' WHEN 3 THEN 'Plain' WHEN 4 THEN 'Twice' ELSE 'Main' END", "CASE kind WHEN 1 THEN 'Flat rate ' || k WHEN 3 THEN '1[Text under rule ' || target || '(4) goes further]' WHEN 5 THEN 'Subject to section ' || target || '(2), it ends' ELSE '' END", "TRUE"),
        row(f"{sec} || 'a'", "section", "seq || 'A'", null, 0, "'Inserted'", "'New'", "kind = 5"),
        row(f"{sec} || '__subsec_1'", "subsection", "'(1)'", sec, 1, null, "CASE kind WHEN 0 THEN 'Tax is due on item ' || k || ';' WHEN 2 THEN 'clause (b) of sub-section (2) of section ' || target || ' is read' ELSE 'section ' || target || '(1)(a)(i) has it' END", "kind IN (0, 2, 4)"),
        row(f"{sec} || '__subsec_1__cl_a'", "clause", "'(a)'", f"{sec} || '__subsec_1'", 2, null, "'as the proviso to section ' || target || ' says;'", "kind = 0"),
        row(f"{sec} || '__subsec_1__cl_a__subcl_i'", "subclause", "'(i)'", f"{sec} || '__subsec_1__cl_a'", 3, null, "'sub one'", "kind = 0"),
        row(f"{sec} || '__subsec_1__cl_a__subcl_ii'", "subclause", "'(ii)'", f"{sec} || '__subsec_1__cl_a'", 3, null, "'sub two'", "kind = 0"),
        row(f"{sec} || '__subsec_1__cl_b'", "clause", "'(b)'", f"{sec} || '__subsec_1'", 2, null, "'second clause'", "kind = 0"),
        row(f"{sec} || '__proviso_1'", "proviso", "'Provided that'", sec, 1, null, "'Explanation 2 to clause (b) of section ' || target || ' holds'", "kind = 1"),
        row(f"{sec} || '__proviso_2'", "proviso", "'Provided further that'", sec, 1, null, "'it is none'", "kind = 1"),
        row(f"{sec} || '__subsec_2'", "subsection", "'(2)'", sec, 1, null, "'two'", "kind = 2"),
        row(f"{sec} || '__subsec_2__expl'", "explanation", "'Explanation'", f"{sec} || '__subsec_2'", 2, null, "'three'", "kind = 2"),
        row(f"{sec} || '__subsec_2__expl_2'", "explanation", "'Explanation 2'", f"{sec} || '__subsec_2'", 2, null, "'four'", "kind = 2"),
        row(f"{sec} || '__subsec_1__dup2'", "subsection", "'(1)'", sec, 1, null, "'as section ' || target || ' of the Central Excise Act, 1944 has it'", "kind = 4"),
        row("'schedule_1'", "schedule", "'I'", null, 0, null, "''", "seq = top"),
        row("'schedule_1__item_1'", "schedule_item", "'1'", "'schedule_1'", 1, null, "'first item'", "seq = top"),
        row("'schedule_1__item_1__cl_a'", "clause", "'(a)'", "'schedule_1__item_1'", 2, null, "'inside'", "seq = top"),
        row("'schedule_1__item_2'", "schedule_item", "'2'", "'schedule_1'", 1, null, "'second item'", "seq = top"),
    ]
    return " UNION ALL ".join(parts)


@register("act_provisions", ACTS.over(f", n AS ({_nodes()}) SELECT doc_id, eid, kind, num, parent_eid, CAST(depth AS INTEGER) AS depth, heading, text FROM n"))
def act_provisions(spark, sf_dir):
    return statute.provisions(statute.parse(act_lines(spark, sf_dir), parts=("provisions",))).select("doc_id", "eid", "kind", "num", "parent_eid", "depth", "heading", "text")


@register(
    "act_citations",
    ACTS.over(
        f""", n AS ({_nodes()}), c AS (SELECT doc_id,
          'sec_' || seq || CASE kind WHEN 0 THEN '__subsec_1__cl_a' WHEN 1 THEN '__proviso_1' WHEN 2 THEN '__subsec_1' WHEN 4 THEN '__subsec_1' ELSE '' END AS parent_eid,
          CASE kind WHEN 3 THEN 'rule_' || target || '__subrule_4' ELSE 'sec_' || target || CASE kind WHEN 0 THEN '__proviso_1' WHEN 1 THEN '__cl_b__expl_2' WHEN 2 THEN '__subsec_2__cl_b' WHEN 4 THEN '__subsec_1__cl_a__subcl_i' ELSE '__subsec_2' END END AS target_eid,
          CASE kind WHEN 5 THEN 'subject_to' ELSE 'reference' END AS relation, kind = 3 AS external FROM t
          UNION ALL SELECT doc_id, 'sec_' || seq || '__subsec_1__dup2', 'sec_' || target, 'reference', TRUE FROM t WHERE kind = 4)
        SELECT c.*, NOT external AND EXISTS (SELECT 1 FROM n WHERE n.doc_id = c.doc_id AND n.eid = c.target_eid) AS resolved FROM c"""
    ),
)
def act_citations(spark, sf_dir):
    return statute.citations(statute.parse(act_lines(spark, sf_dir), cite=True, parts=())).select("doc_id", "parent_eid", "target_eid", "relation", "external", "resolved")


@register("act_notes", ACTS.over("SELECT doc_id, '1' AS number, 'sec_' || min(seq) FILTER (kind = 3) AS associated_eid, 'substituted' AS action, 'Act 12 of 2020' AS amending_act, 's. 118' AS amending_section, '1-1-2021' AS effective_date, 'old' AS substituted_for FROM t GROUP BY doc_id"))
def act_notes(spark, sf_dir):
    notes = statute.footnotes(statute.parse(act_lines(spark, sf_dir), parts=("notes",)))
    return notes.select("doc_id", "number", "associated_eid", "amendment.action", "amendment.amending_act", "amendment.amending_section", "amendment.effective_date", "amendment.substituted_for")


@register("act_amendments", ACTS.over("SELECT doc_id, 'sec_' || min(seq) AS eid, 'substituted' AS action FROM t WHERE kind = 3 GROUP BY doc_id"))
def act_amendments(spark, sf_dir):
    return statute.attached_amendments(statute.footnotes(statute.parse(act_lines(spark, sf_dir), parts=("notes",)))).select("doc_id", "eid", "amendment.action")


@register("act_diagnostics", ACTS.over("SELECT doc_id, 'statute.preamble_recovered' AS code, 1 AS n FROM t WHERE seq = 1 UNION ALL SELECT doc_id, 'statute.duplicate_provision_eid', count(*) FROM t WHERE kind = 4 GROUP BY doc_id"))
def act_diagnostics(spark, sf_dir):
    return statute.diagnostics(statute.parse(act_lines(spark, sf_dir), parts=("diagnostics",))).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@register("act_titles", ACTS.over("SELECT doc_id, 'The Levy of Items Act, ' || (2000 + doc_id % 20) AS title, 'Act 12 of ' || (2000 + doc_id % 20) AS act_number, CAST(2000 + doc_id % 20 AS VARCHAR) AS act_year FROM t WHERE seq = 1"))
def act_titles(spark, sf_dir):
    return statute.metadata(statute.parse(act_lines(spark, sf_dir), parts=("provisions",))).select("doc_id", "title", "act_number", "act_year")


# --- Region types -------------------------------------------------------------------------------------------------


@register(
    "classified_lines",
    LINES.over(
        """, p AS (SELECT doc_id, least(4, greatest(2, ceil(count(DISTINCT page_index) * 0.35))) AS needed, count(*) FILTER (reading_order = 0) AS heads, count(*) FILTER (reading_order = 9) AS folios FROM t GROUP BY doc_id)
        SELECT t.doc_id, page_index, line_id, CASE WHEN reading_order = 0 AND heads >= needed THEN 'header' WHEN reading_order = 9 AND folios >= needed THEN 'footer' WHEN reading_order = 8 AND k % 3 <> 0 THEN 'footnote' WHEN reading_order = 3 THEN 'heading' ELSE 'body' END AS region_type,
               CAST(row_number() OVER (PARTITION BY t.doc_id, page_index ORDER BY reading_order) - 1 AS INTEGER) AS block_index FROM t JOIN p ON p.doc_id = t.doc_id"""
    ),
)
def classified_lines(spark, sf_dir):
    y = F.when(F.col("reading_order") == 9, 740.0).otherwise(F.col("reading_order") * 75.0 + 12)
    box = F.struct(F.lit(100.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 12).alias("y1"))
    size = F.when((F.col("reading_order") == 8) & (F.col("k") % 3 != 0), 8.0).otherwise(10.0)
    span = F.struct("text", size.alias("size"), F.lit(False).alias("superscript"), F.lit(0).alias("start"), F.length("text").alias("end"))
    rows = lines(spark, sf_dir).withColumns({"bbox": box, "spans": F.array(span)})
    return classify.classify(rows, pages(spark, sf_dir)).select("doc_id", "page_index", "line_id", "region_type", "block_index")
