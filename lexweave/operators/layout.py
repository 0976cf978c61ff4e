"""Page layout: columns, reading order, tables, contents pages, overlap suppression."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import geometry as G
from lexweave.functions import shapes as S
from lexweave.functions import text as T

# --- Fixed values -----------------------------------------------------------------------------------

WIDEST_COLUMN, LEAST_CANDIDATES, WIDE_SHARE = 0.55, 6, 0.40
LEAST_GAP, SPLIT_RANGE, SIDE_LINES, SIDE_OVERLAP = 0.12, (0.25, 0.75), 3, 0.30
MIDDLE_RANGE, LIKE_WIDTHS, SPANNING_SHARE = (0.40, 0.60), 0.60, 0.20
PARALLEL_VOTES, FRENCH_VOTES = 8, 3
MARGIN_SIZE, MARGIN_WIDTH, MARGIN_PROSE, MARGIN_GAP = 0.90, 0.25, 3, (1.5, 0.02)
TABLE_NOTE_REACH, TABLE_NOTE_GAP = 3.0, 1.6

# ----------------------------------------------------------------------------------------------------


def geometry_order(lines: DataFrame) -> DataFrame:
    """Rank of each line by the height of its centre, then its centre across, its left edge and its id."""
    order = Window.partitionBy("doc_id", "page_index").orderBy(G.center_y(F.col("bbox")), G.center_x(F.col("bbox")), F.col("bbox.x0"), F.col("line_id"))
    return lines.select("doc_id", "page_index", "line_id", F.row_number().over(order).alias("rank"))


def column_models(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """kind (two_column, margin_column) and split_x of the pages that have columns.

    A split lies between two neighbouring centres of narrow lines that are far enough apart, near the middle,
    with three lines on either side whose heights overlap. The split that fewest lines cross wins, then the
    widest gap. Splits are few, so that each is compared with its page's lines by an equi-join on the page.
    """
    page = ["doc_id", "page_index"]
    boxed = lines.where(G.is_valid(F.col("bbox")) & ~F.coalesce(F.col("region_type").isin("header", "footer"), F.lit(False))).join(pages.select(*page, F.col("width").alias("page_width")).where("page_width > 0"), page)
    narrow = F.col("share") <= WIDEST_COLUMN
    shaped = boxed.withColumns({"share": G.width(F.col("bbox")) / F.col("page_width"), "cx": G.center_x(F.col("bbox"))})
    counts = shaped.groupBy(*page).agg(F.count_if(narrow).alias("narrow"), F.count("*").alias("all"))
    fit = counts.where((F.col("narrow") >= LEAST_CANDIDATES) & (1 - F.col("narrow") / F.col("all") <= WIDE_SHARE)).select(*page)
    rows = shaped.where(narrow).join(fit, page).select(*page, "page_width", "share", "cx", "bbox", "line_id")
    order = Window.partitionBy(*page).orderBy("cx", "line_id")
    split = (F.col("cx") + F.lead("cx").over(order)) / 2
    splits = rows.select(*page, "page_width", split.alias("split_x"), (F.lead("cx").over(order) - F.col("cx")).alias("gap"))
    splits = splits.where((F.col("gap") / F.col("page_width") >= LEAST_GAP) & (F.col("split_x") / F.col("page_width")).between(*SPLIT_RANGE)).drop("page_width")
    left = F.col("cx") < F.col("split_x")
    when = lambda side, c: F.when(left if side == "l" else ~left, c)
    met = splits.join(rows, page).groupBy(*page, "split_x", "gap").agg(
        F.first("page_width").alias("page_width"),
        F.count_if((F.col("bbox.x0") < F.col("split_x")) & (F.col("bbox.x1") > F.col("split_x"))).alias("crossings"),
        *(f(when(side, F.col(c))).alias(f"{side}{name}") for side in "lr" for f, c, name in ((F.count, "cx", "_n"), (F.min, "bbox.y0", "_top"), (F.max, "bbox.y1", "_end"))),
        *(F.sort_array(F.collect_list(when(side, F.col("share")))).alias(f"{side}_shares") for side in "lr"),
    )
    span = F.greatest("l_end", "r_end") - F.least("l_top", "r_top")
    shared = F.greatest(F.least("l_end", "r_end") - F.greatest("l_top", "r_top"), F.lit(0.0))
    fair = met.where((F.col("l_n") >= SIDE_LINES) & (F.col("r_n") >= SIDE_LINES) & (span > 0) & (shared / span >= SIDE_OVERLAP))
    middle = lambda c: F.get(c, F.floor(F.size(c) / 2).cast("int"))
    lw, rw = middle("l_shares"), middle("r_shares")
    two = ((F.col("crossings") == 0) & F.bround(F.col("split_x") / F.col("page_width"), 4).between(*MIDDLE_RANGE)) | (F.least(lw, rw) / F.greatest(lw, rw) >= LIKE_WIDTHS)
    named = fair.withColumn("kind", F.when(two, "two_column").otherwise("margin_column"))
    best = F.min_by(F.struct("kind", "split_x", "crossings", "l_n", "r_n"), F.struct("crossings", -F.col("gap"), F.col("split_x")))
    return named.groupBy(*page).agg(best.alias("b")).select(*page, "b.kind", "b.split_x", "b.crossings", F.col("b.l_n").alias("left_lines"), F.col("b.r_n").alias("right_lines"))


def column_order(lines: DataFrame, models: DataFrame) -> DataFrame:
    """Reading order over columns: what stands above both columns, then left and right between the lines that
    span the split, then what stands below; plain geometry order where a side is empty."""
    page = ["doc_id", "page_index"]
    cy, cx, width = G.center_y(F.col("bbox")), G.center_x(F.col("bbox")), G.width(F.col("bbox"))
    met = lines.join(models.select(*page, "split_x"), page, "left").withColumns({"cy": cy, "cx": cx})
    spans = F.coalesce((width > 0) & (F.col("bbox.x0") <= F.col("split_x") - width * SPANNING_SHARE) & (F.col("bbox.x1") >= F.col("split_x") + width * SPANNING_SHARE), F.lit(False))
    met = met.withColumns({"spans": spans, "right": F.coalesce(F.col("cx") >= F.col("split_x"), F.lit(False))})
    whole = Window.partitionBy(*page)
    side = lambda right: F.when(G.is_valid(F.col("bbox")) & ~F.col("spans") & F.col("split_x").isNotNull() & (F.col("right") == right), F.col("cy"))
    met = met.withColumns({n: f(side(r)).over(whole) for n, f, r in (("lt", F.min, False), ("lb", F.max, False), ("rt", F.min, True), ("rb", F.max, True))})
    low, high = F.greatest("lt", "rt"), F.least("lb", "rb")
    both = F.col("lt").isNotNull() & F.col("rt").isNotNull()
    band = F.when(both, F.when(F.col("cy") > high, 2).when(F.col("cy") >= low, 1).otherwise(0)).otherwise(0)
    met = met.withColumns({"both": both, "band": band})
    anchor = F.when(F.col("spans") & (F.col("band") == 1), 1).otherwise(0)
    above = Window.partitionBy(*page, "band").orderBy("cy").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("anchor", anchor).withColumn("segment", F.sum("anchor").over(above) - F.sum("anchor").over(Window.partitionBy(*page, "band", "cy")))
    inside = (F.col("band") == 1) & F.col("both")
    keys = [F.col("band"), F.when(inside, F.col("segment")).otherwise(0), F.when(inside, F.col("anchor")).otherwise(0), F.when(inside & (F.col("anchor") == 0), F.col("right").cast("int")).otherwise(0), F.col("cy"), F.when(inside | ~F.col("both"), F.col("cx")).otherwise(F.lit(0.0)), F.col("bbox.x0"), F.col("line_id")]
    return met.select(*page, "line_id", F.row_number().over(Window.partitionBy(*page).orderBy(*keys)).alias("reading_order"))


def page_order(lines: DataFrame) -> DataFrame:
    """Headers, then body and notes in their own order, then footers."""
    part = F.when(F.col("region_type") == "header", 0).when(F.col("region_type") == "footer", 3).when(F.col("region_type") == "footnote", 2).otherwise(1)
    order = Window.partitionBy("doc_id", "page_index").orderBy(part, "source_order", "line_id")
    return lines.select("doc_id", "page_index", "line_id", (F.row_number().over(order) - 1).alias("reading_order"))


def order_scores(lines: DataFrame) -> DataFrame:
    """Per page: changes of column, hyphens that the next line closes, and lines that stand above their predecessor."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("reading_order", "line_id")
    seen = lines.select("doc_id", "page_index", "text", "bbox", F.lag("text").over(order).alias("p_text"), F.lag("bbox").over(order).alias("p_box"), F.col("column_no"), F.lag("column_no").over(order).alias("p_column"))
    closes = S.is_shape("hyphen_tail", F.trim("p_text"))
    return seen.groupBy("doc_id", "page_index").agg(
        F.count_if(F.col("column_no") != F.col("p_column")).alias("switches"),
        F.count_if(closes & F.col("text").rlike(r"^\s*\p{Ll}")).alias("closed"),
        F.count_if(closes).alias("hyphens"),
        F.count_if(F.col("bbox.y0") < F.col("p_box.y0")).alias("regressions"),
    )


def column_runs(lines: DataFrame) -> DataFrame:
    """Upper median length of the runs of lines in one column, per page."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("reading_order", "line_id")
    starts = lines.withColumn("new", F.coalesce((F.col("column_no") != F.lag("column_no").over(order)).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "page_index", "run").agg(F.count("*").alias("n"))
    listed = runs.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list("n")).alias("ns"))
    return listed.select("doc_id", "page_index", F.get("ns", F.floor(F.size("ns") / 2).cast("int")).alias("median_run"))


def contents_grid(lines: DataFrame, pages: DataFrame, least: int = 6, rising: float = 0.8) -> DataFrame:
    """Pages with six or more numbers at the right edge of which four fifths do not fall."""
    number = F.regexp_extract("text", r"(\d{1,4})\s*$", 1)
    sized = lines.join(pages.select("doc_id", "page_index", "width"), ["doc_id", "page_index"])
    rows = sized.where((number != "") & (F.col("bbox.x1") > F.col("width") * 0.8)).select("doc_id", "page_index", "reading_order", "line_id", number.cast("int").alias("n"))
    order = Window.partitionBy("doc_id", "page_index").orderBy("reading_order", "line_id")
    seen = rows.withColumn("ok", F.col("n") >= F.lag("n").over(order))
    told = seen.groupBy("doc_id", "page_index").agg(F.count("*").alias("entries"), F.count_if("ok").alias("rises"))
    return told.where((F.col("entries") >= least) & (F.col("rises") >= rising * (F.col("entries") - 1)))


def index_pages(lines: DataFrame, least: int = 5, rising: float = 0.8) -> DataFrame:
    """Pages of an index: five or more entries [n] p:l, or five or more headwords that mostly ascend."""
    headword = r"^\s*(\S+(?:\s\S+){0,2}?)\s+(?:[\[(]\d{1,3}[\])]\s*$|(?:[\[(]\d{1,3}[\])]\s+)?\d{1,4}[:/]\d{1,3}(?:[\s,;]|$))"
    order = Window.partitionBy("doc_id", "page_index").orderBy("reading_order", "line_id")
    words = lines.select("doc_id", "page_index", "reading_order", "line_id", F.regexp_count("text", F.lit(S.PATTERNS["index_entry"])).alias("entries"), F.when(F.col("text").rlike(headword), F.lower(F.regexp_extract("text", headword, 1))).alias("word"))
    before = F.last("word", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = words.withColumn("up", F.col("word") >= before)
    told = seen.groupBy("doc_id", "page_index").agg(F.sum("entries").alias("entries"), F.count("word").alias("headwords"), F.count_if("up").alias("ups"))
    return told.where((F.col("entries") >= least) | ((F.col("headwords") >= least) & (F.col("ups") >= rising * (F.col("headwords") - 1))))


def transcript_pages(lines: DataFrame, pages: DataFrame, share: float = 0.03, top: int = 15) -> DataFrame:
    """Pages whose left margin holds the numbers 1 to 15 in one narrow strip."""
    sized = lines.join(pages.select("doc_id", "page_index", "width"), ["doc_id", "page_index"])
    numbers = sized.where(F.col("text").rlike(r"^\s*\d{1,2}\s*$")).select("doc_id", "page_index", F.trim("text").cast("int").alias("n"), (F.col("bbox.x0") / F.col("width")).alias("x")).where(F.col("n").between(1, top))
    # Ranges of windows are whole numbers: places are counted in millionths of the width.
    strip = Window.partitionBy("doc_id", "page_index").orderBy(F.round(F.col("x") * 1_000_000).cast("bigint")).rangeBetween(0, round(share * 1_000_000))
    return numbers.withColumn("seen", F.size(F.collect_set("n").over(strip))).groupBy("doc_id", "page_index").agg(F.max("seen").alias("seen")).where(F.col("seen") >= top).select("doc_id", "page_index")


def table_rows(lines: DataFrame) -> DataFrame:
    """Rows of cells: lines whose centres fall into one band of three quarters of the page's median line height."""
    listed = lines.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(G.height(F.col("bbox")))).alias("hs"))
    heights = listed.select("doc_id", "page_index", F.get("hs", F.floor(F.size("hs") / 2).cast("int")).alias("h"))
    met = lines.join(heights, ["doc_id", "page_index"])
    row = F.round(G.center_y(F.col("bbox")) / (0.75 * F.col("h"))).cast("bigint")
    cells = met.groupBy("doc_id", "page_index", row.alias("row_no")).agg(F.count("*").alias("cells"), F.sort_array(F.collect_list(F.length("text"))).alias("ns"), F.count_if(F.col("text").rlike(r"^[\s\d.,%()$€£-]*\d[\s\d.,%()$€£-]*$")).alias("numeric_cells"))
    median = F.get("ns", F.floor(F.size("ns") / 2).cast("int"))
    return cells.select("doc_id", "page_index", "row_no", "cells", "numeric_cells", median.alias("median_chars"), ((F.col("cells") >= 2) & (median <= 24)).alias("dense"))


def language_columns(lines: DataFrame, minimum: int = PARALLEL_VOTES) -> DataFrame:
    """The language of each column of a page by function words: en, fr or null."""
    votes = lines.groupBy("doc_id", "page_index", "column_no").agg(F.sum(T.stopword_votes(F.col("text"), T.ENGLISH_WORDS)).alias("english"), F.sum(T.stopword_votes(F.col("text"), T.FRENCH_WORDS)).alias("french"))
    return votes.withColumn("language", T.column_language(F.col("english"), F.col("french"), minimum))


def translation_lines(lines: DataFrame) -> DataFrame:
    """Lines of the French column of documents that print English beside French on some page.

    The side that is French on most of those pages is the document's; its lines are the translation on those
    pages and wherever a few of its words are French.
    """
    told = language_columns(lines)
    two = told.where("language is not null").groupBy("doc_id", "page_index").agg(F.countDistinct("language").alias("n"), F.max(F.when(F.col("language") == "fr", F.col("column_no"))).alias("side")).where("n = 2")
    sides = two.groupBy("doc_id", "side").agg(F.count("*").alias("pages")).groupBy("doc_id").agg(F.max(F.struct("pages", "side")).alias("best")).select("doc_id", F.col("best.side").alias("column_no"))
    sure = two.select("doc_id", "page_index", F.col("side").alias("column_no"), F.lit(True).alias("sure"))
    few = T.column_language(F.col("english"), F.col("french"), FRENCH_VOTES) == "fr"
    chosen = told.join(sides, ["doc_id", "column_no"]).join(sure, ["doc_id", "page_index", "column_no"], "left").where(F.coalesce("sure", F.lit(False)) | F.coalesce(few, F.lit(False)))
    return lines.join(chosen.select("doc_id", "page_index", "column_no"), ["doc_id", "page_index", "column_no"]).select("doc_id", "page_index", "line_id")


def suppress_overlaps(boxes: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Greedy suppression on each page: in order of score, a box goes if it overlaps a kept one by the threshold."""
    kind = boxes.schema["doc_id"].dataType.simpleString()
    listed = boxes.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(F.struct(F.col("score").cast("double").alias("score"), F.col("box_id").cast("string").alias("box_id"), F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1"))), asc=False).alias("boxes"))

    def rows(batches):
        for batch in batches:
            made = []
            for items in batch.column("boxes").to_pylist():
                kept: list[dict] = []
                for b in items:
                    if all(overlap(b, k) < threshold for k in kept):
                        kept.append(b)
                made.append([k["box_id"] for k in kept])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_index"), pa.array(made, pa.list_(pa.string()))], names=["doc_id", "page_index", "kept"])

    page = boxes.schema["page_index"].dataType.simpleString()
    return listed.mapInArrow(rows, f"doc_id {kind}, page_index {page}, kept array<string>").select("doc_id", "page_index", F.explode("kept").alias("box_id"))


def overlap(a: dict, b: dict) -> float:
    """Intersection over union of two boxes."""
    across, down = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    shared = max(0.0, across) * max(0.0, down)
    size = lambda r: max(0.0, r["x1"] - r["x0"]) * max(0.0, r["y1"] - r["y0"])
    whole = size(a) + size(b) - shared
    return shared / whole if whole > 0 else 0.0


def top_detections(scores: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k best logits of a page as probabilities, those above the threshold, in order."""
    order = Window.partitionBy("doc_id", "page_index").orderBy(F.desc("logit"), "box_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("score", 1 / (1 + F.exp(-F.col("logit")))).where(F.col("score") >= threshold).select("doc_id", "page_index", "box_id", "rank", "score")


def double_painted(items: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Items without those that repeat the text of the one before at the same place."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("seq")
    same = (F.col("text") == F.lag("text").over(order)) & (F.abs(F.col("bbox.x0") - F.lag("bbox.x0").over(order)) <= tolerance) & (F.abs(F.col("bbox.y0") - F.lag("bbox.y0").over(order)) <= tolerance)
    return items.withColumn("again", F.coalesce(same, F.lit(False))).where("not again").drop("again")


def length_buckets(lines: DataFrame, width: int, batch: int) -> DataFrame:
    """Batches of lines of like widths, the widest first: bucket, batch and place of each line."""
    bucket = F.ceil(F.col("line_width") / width).cast("int")
    order = Window.partitionBy("bucket").orderBy("line_id")
    rows = lines.withColumn("bucket", bucket).withColumn("n", F.row_number().over(order) - 1)
    return rows.select("line_id", "bucket", F.floor(F.col("n") / batch).cast("int").alias("batch"), (F.col("n") % batch).cast("int").alias("place"))


def margin_models(lines: DataFrame, labels: DataFrame, pages: DataFrame, minimum: int = 1) -> DataFrame:
    """Pages whose note labels stand in a margin lane beside the body: kind, split_x, left_lines, right_lines.

    lines: doc_id, page_index, line_id, text, bbox, size, region_type, exclude_from_body; labels: doc_id,
    page_index, line_id; pages: doc_id, page_index, width, body_size. The lane left or right of the middle with
    more labels counts, the right one if they are equal. A lane reaches over its labels and the bodies beside
    labels that stand alone; three or more body lines must stand beside it, a gap apart.
    """
    from lexweave.operators.regions import nearest_label

    page, lane = ["doc_id", "page_index"], ["doc_id", "page_index", "right"]
    sized = pages.select(*page, "width", "body_size").where("width > 0 and body_size > 0")
    own = lines.join(labels.select(*page, "line_id").distinct(), [*page, "line_id"]).join(sized, page).withColumn("right", G.center_x(F.col("bbox")) >= F.col("width") / 2)
    alone = own.where(S.is_shape("note_label_alone", F.col("text")))
    bodies = nearest_label(alone.select(*page, "line_id", "bbox"), lines).join(lines.select(*page, F.col("line_id").alias("body_id"), F.col("bbox").alias("body")), [*page, "body_id"]).select(*page, "line_id", "body")
    edges = own.join(bodies, [*page, "line_id"], "left")
    end = lambda f, e: f(F.when(F.col(f"body.{e}").isNull(), F.col(f"bbox.{e}")).otherwise((F.least if f is F.min else F.greatest)(F.col(f"bbox.{e}"), F.col(f"body.{e}"))))
    lanes = edges.groupBy(*lane).agg(F.count("*").alias("n"), end(F.min, "x0").alias("note_left"), end(F.max, "x1").alias("note_right"), end(F.min, "y0").alias("top"), end(F.max, "y1").alias("bottom")).where(F.col("n") >= minimum)
    prose = lines.where(G.is_valid(F.col("bbox")) & ~F.coalesce("exclude_from_body", F.lit(False)) & ~F.coalesce(F.col("region_type").isin("header", "footer"), F.lit(False)))
    prose = prose.join(sized, page).where((F.col("size") >= F.col("body_size") * MARGIN_SIZE) & (G.width(F.col("bbox")) >= F.col("width") * MARGIN_WIDTH)).select(*page, "line_id", F.col("bbox").alias("p"), "width", "body_size")
    beside = lanes.join(prose, page).where((F.col("p.y1") >= F.col("top")) & (F.col("p.y0") <= F.col("bottom"))).join(own.select(*lane, "line_id"), [*lane, "line_id"], "left_anti")
    told = beside.groupBy(*lane, "n", "note_left", "note_right", "width", "body_size").agg(F.count("*").alias("prose"), F.min("p.x0").alias("body_left"), F.max("p.x1").alias("body_right")).where(F.col("prose") >= MARGIN_PROSE)
    gap = F.greatest(F.col("body_size") * MARGIN_GAP[0], F.col("width") * MARGIN_GAP[1])
    split = F.when(F.col("note_right") + gap <= F.col("body_left"), (F.col("note_right") + F.col("body_left")) / 2).when(F.col("body_right") + gap <= F.col("note_left"), (F.col("body_right") + F.col("note_left")) / 2)
    fair = told.withColumn("split_x", split).where("split_x is not null")
    best = fair.groupBy(*page).agg(F.max_by(F.struct("split_x", F.when(F.col("right"), F.col("prose")).otherwise(F.col("n")).alias("l"), F.when(F.col("right"), F.col("n")).otherwise(F.col("prose")).alias("r")), F.struct("n", "right")).alias("b"))
    return best.select(*page, F.lit("margin_column").alias("kind"), "b.split_x", F.col("b.l").alias("left_lines"), F.col("b.r").alias("right_lines"))


def table_notes(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines of notes with symbols under or inside a table, and the lines that follow them downwards.

    lines: doc_id, page_index, line_id, text, bbox, in_table, in_cell; tables: doc_id, page_index, bottom,
    line_height. A note starts at a symbol with four letters after it; it goes on until a gap, a cell or a caption.
    """
    page = ["doc_id", "page_index"]
    met = lines.join(tables.select(*page, "bottom", "line_height"), page)
    rest = F.regexp_replace("text", rf"^\s*[{T.NOTE_SYMBOLS}]{{1,8}}", "")
    symbol = T.label_prefix(F.col("text")).rlike("^[^0-9]+$") & (F.length(S.letters(rest)) >= 4)
    below = (F.col("bbox.y0") > F.col("bottom")) & (F.col("bbox.y0") <= F.col("bottom") + F.col("line_height") * TABLE_NOTE_REACH)
    anchors = met.where(F.coalesce(symbol, F.lit(False)) & ((~F.col("in_table") & F.col("in_cell")) | below)).select(*page, F.col("line_id").alias("anchor"), F.col("bbox").alias("a"))
    after = met.join(anchors, page).where((F.col("line_id") != F.col("anchor")) & (F.col("bbox.y0") >= F.col("a.y0")))
    order = Window.partitionBy(*page, "anchor").orderBy("bbox.y0", "line_id")
    reached = F.greatest(F.col("a.y1"), F.max("bbox.y1").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ends = (F.col("bbox.y0") - reached > F.col("line_height") * TABLE_NOTE_GAP) | F.col("in_cell") | S.is_shape("table_caption", F.col("text"))
    grown = after.withColumn("ends", ends.cast("int")).withColumn("ended", F.max("ends").over(order))
    return grown.where("ended = 0").select(*page, "line_id").unionByName(anchors.select(*page, F.col("anchor").alias("line_id"))).distinct()


def class_detections(boxes: DataFrame, class_top: int, keep: int, threshold: float, overlap_limit: float) -> DataFrame:
    """Detections after suppression inside each class: the class_top best of a class, then keep of a page, in order.

    boxes: doc_id, page_index, query, label, score, bbox. Scores at or below the threshold, boxes without extent and
    values that are not finite go first, before anything is gathered. Rows: rank, query, label, score.
    """
    page = ["doc_id", "page_index"]
    kinds = {c: boxes.schema[c].dataType.simpleString() for c in page}
    finite = ~F.isnan("score") & (F.abs("score") < F.lit(float("inf")))
    order = Window.partitionBy(*page, "label").orderBy(F.desc("score"), "query")
    best = boxes.where(finite & (F.col("score") > threshold) & G.is_valid(F.col("bbox"))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= class_top)
    item = F.struct((-F.col("score")).cast("double").alias("down"), F.col("label").cast("int").alias("label"), F.col("query").cast("int").alias("query"), *[F.col(f"bbox.{e}").cast("double").alias(e) for e in ("x0", "y0", "x1", "y1")])
    listed = best.groupBy(*page).agg(F.array_sort(F.collect_list(item)).alias("boxes"))

    def rows(batches):
        for batch in batches:
            made = []
            for items in batch.column("boxes").to_pylist():
                kept: list[dict] = []
                for b in items:
                    if len(kept) < keep and all(k["label"] != b["label"] or overlap(b, k) <= overlap_limit for k in kept):
                        kept.append(b)
                made.append([{"query": k["query"], "label": k["label"], "score": -k["down"]} for k in kept])
            kind = pa.list_(pa.struct([("query", pa.int32()), ("label", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_index"), pa.array(made, kind)], names=[*page, "kept"])

    done = listed.mapInArrow(rows, f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, kept array<struct<query:int,label:int,score:double>>")
    return done.select(*page, F.posexplode("kept").alias("rank", "k")).select(*page, "rank", "k.*")
