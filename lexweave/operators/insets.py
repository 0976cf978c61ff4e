"""Block quotes among the text regions of a page, by how far they are set in from their column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import geometry as G
from lexweave.functions import shapes as S
from lexweave.functions import stats

# --- Fixed values -----------------------------------------------------------------------------------

COLUMN_SPLIT = 0.54
SURE, IN_CONTEXT, LEAST_LINES, LEAST_ROWS = 0.68, 0.45, 2, 3
LEFT_SCALE, RIGHT_SCALE, NARROW_SCALE, LEAST_SCALE = 0.035, 0.030, 0.18, 22.0
NARROW_WEIGHT, LEFT_WEIGHT, RIGHT_WEIGHT = 0.50, 0.35, 0.15
LOW_PLACE, HIGH_PLACE = 0.10, 0.90
GROUP_STEP, GROUP_MOST, SHORT_MARGIN, STRONG_MARGIN, STRONG_LINES = 0.025, 0.10, 0.12, 0.08, 3
SPILL_SCORE, SPILL_SHARE, SPILL_LEAST = 0.25, 0.006, 10.0
BELOW_LEAST, BELOW_SHARE, BELOW_MOST, BELOW_OVERLAP = -12.0, 0.035, 90.0, 0.08

# ----------------------------------------------------------------------------------------------------

PAGE = ["doc_id", "page_index"]


def _column(box: Column) -> Column:
    return ((F.col("page_width") > 0) & (G.center_x(box) > F.col("page_width") * COLUMN_SPLIT)).cast("int")


def _note_below(boxes: DataFrame, notes: DataFrame, key: list[str]) -> DataFrame:
    """The least distance from each box (key, column_no, bbox, page_height) down to a note of its column."""
    gap = F.col("note.y0") - F.col("bbox.y1")
    shared = F.greatest(F.least("bbox.x1", "note.x1") - F.greatest("bbox.x0", "note.x0"), F.lit(0.0)) / F.greatest(F.least(G.width(F.col("bbox")), G.width(F.col("note"))), F.lit(1.0))
    near = gap.between(F.lit(BELOW_LEAST), F.greatest(F.col("page_height") * BELOW_SHARE, F.lit(BELOW_MOST))) & (shared >= BELOW_OVERLAP)
    return boxes.join(notes, [*PAGE, "column_no"]).where(near).groupBy(*key).agg(F.min(gap).alias("below"))


def block_quotes(regions: DataFrame) -> DataFrame:
    """Labels of the text regions of pages: text, block_quote, or footnote where a weak region runs into the notes.

    regions: doc_id, page_index, region_id, label, bbox, score, line_count, page_width, page_height. A region's score
    weighs its width and its ends against percentiles of its column; runs of inset regions in reading order are
    quotes by their median score, their lines and what stands before and after them. Pages with fewer than three
    text regions stay as they are. Rows: doc_id, page_index, region_id, label.
    """
    placed = regions.withColumn("column_no", _column(F.col("bbox")))
    notes = placed.where(F.col("label").isin(*S.NOTE_REGIONS)).select(*PAGE, "column_no", F.col("bbox").alias("note"))
    texts = placed.where("label = 'text'")
    weak = _note_below(texts.where(F.col("score") <= SPILL_SCORE), notes, [*PAGE, "region_id"])
    order = Window.partitionBy(*PAGE).orderBy("bbox.y0", G.center_x(F.col("bbox")), "bbox.x0", "region_id")
    spill = F.coalesce(F.col("below") <= F.greatest(F.col("page_height") * SPILL_SHARE, F.lit(SPILL_LEAST)), F.lit(False))
    rows = texts.join(weak, [*PAGE, "region_id"], "left").withColumns({"spill": spill, "place": F.row_number().over(order), "rows": F.count("*").over(Window.partitionBy(*PAGE)), "width": G.width(F.col("bbox"))})
    widest = F.greatest("page_width", F.lit(1.0))
    at = lambda c, p: stats.nearest_rank(F.array_sort(F.collect_list(c)), p)
    ends = rows.groupBy(*PAGE, "column_no").agg(F.count("*").alias("n"), at("bbox.x0", LOW_PLACE).alias("left"), at("bbox.x1", HIGH_PLACE).alias("right"), at("width", HIGH_PLACE).alias("body")).where(F.col("n") >= LEAST_ROWS).drop("n")
    share = lambda value, scale: F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / F.greatest(scale, F.lit(LEAST_SCALE))))
    inset = NARROW_WEIGHT * share(F.col("body") - F.col("width"), F.col("body") * NARROW_SCALE) + LEFT_WEIGHT * share(F.col("bbox.x0") - F.col("left"), widest * LEFT_SCALE) + RIGHT_WEIGHT * share(F.col("right") - F.col("bbox.x1"), widest * RIGHT_SCALE)
    scored = rows.join(ends, [*PAGE, "column_no"], "left").withColumn("inset_score", F.when(~F.col("spill") & F.col("left").isNotNull(), inset).otherwise(0.0))
    scored = scored.withColumn("inset", F.col("inset_score") >= IN_CONTEXT)
    line = Window.partitionBy(*PAGE).orderBy("place")
    beside = lambda move: F.coalesce((move("column_no").over(line) == F.col("column_no")) & ~move("inset").over(line), F.lit(False))
    seen = scored.withColumns({"body_before": beside(F.lag), "body_after": beside(F.lead)})
    island = F.col("place") - F.row_number().over(Window.partitionBy(*PAGE, "column_no").orderBy("place"))
    members = seen.where("inset").withColumn("island", island)
    key = [*PAGE, "column_no", "island"]
    groups = members.groupBy(*key).agg(
        F.median("inset_score").alias("median"),
        F.count("*").alias("n"),
        F.sum("line_count").alias("lines"),
        F.max_by("body_after", "place").alias("after"),
        F.min_by("body_before", "place").alias("before"),
        stats.union_box(F.col("bbox")).alias("bbox"),
        F.first("page_height").alias("page_height"),
    )
    bounded = groups.join(_note_below(groups, notes, key), key, "left")
    score = F.col("median") + F.least((F.col("n") - 1) * GROUP_STEP, F.lit(GROUP_MOST))
    both, either = F.col("before") & F.col("after"), F.col("before") | F.col("after")
    boundary = F.col("before") & F.col("below").isNotNull()
    short = (F.col("lines") <= 2) & ((score < SURE + SHORT_MARGIN) | ~both)
    enough = score >= F.when(both | boundary, F.lit(IN_CONTEXT)).otherwise(F.lit(SURE))
    strong = either & (score >= SURE + STRONG_MARGIN) & (F.col("lines") >= STRONG_LINES)
    quotes = bounded.where((F.col("lines") >= LEAST_LINES) & ~short & enough & (both | boundary | strong)).select(*key, F.lit(True).alias("quote"))
    named = members.join(quotes, key).select(*PAGE, "region_id", "quote")
    told = rows.join(named, [*PAGE, "region_id"], "left")
    label = F.when(F.col("rows") < LEAST_ROWS, "text").when(F.col("spill"), "footnote").when(F.coalesce("quote", F.lit(False)), "block_quote").otherwise("text")
    return told.select(*PAGE, "region_id", label.alias("label"))
