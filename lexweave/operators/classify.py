"""Region types for lines that come without them: furniture, notes, headings and body, with blocks for paragraphs.

A design of its own, simpler than a full page classifier: what repeats at a page's edge is furniture; notes are the
small type from a rule, or from the first small label, down to the page's end; headings read as headings. There are
no margin notes, endnotes or tables here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import geometry as G
from lexweave.functions import shapes as S
from lexweave.functions import stats
from lexweave.functions import text as T
from lexweave.operators import furniture
from lexweave.operators.candidates import title_plausible

BODY_BAND, BODY_SIZES, DEFAULT_SIZE = (0.10, 0.75), (4.0, 24.0), 10.0
#: A label's line, and what stands under it, as shares of the body's size; how far up a page notes start and go on.
LABEL_SIZE, UNDER_SIZE, NOTE_TOP, CONTINUED_TOP = 0.90, 0.95, 0.30, 0.60
LARGE_LABEL, LAST_LABEL, HEADING_SIZE = 1.15, 0.94, 1.15
#: A line further below the one before than this share of its height begins a block.
BLOCK_GAP = 0.8
PAGE = ["doc_id", "page_index"]


def classify(lines: DataFrame, pages: DataFrame, separators: DataFrame | None = None) -> DataFrame:
    """Lines with region_type (header, footer, footnote, heading, body) and block_index.

    lines: doc_id, page_index, reading_order, line_id, text, bbox, spans; pages: doc_id, page_index, page_number,
    width, height; separators: doc_id, page_index, separator_y of the rules above notes. Documents are worked on by
    page; only repeats at the edges look at whole documents. Lines without sized spans are of the body's size.
    """
    bare = lines.drop("region_type", "block_index", "page_number")
    edges = furniture.repeated_lines(bare, pages).select(*PAGE, "line_id", F.when(F.col("edge") == "top", "header").otherwise("footer").alias("edge"))
    folios = furniture.folio_runs(bare, pages).select(*PAGE, "line_id", F.lit("footer").alias("edge"))
    edge = edges.unionByName(folios).groupBy(*PAGE, "line_id").agg(F.max("edge").alias("edge"))
    rows = bare.join(edge, [*PAGE, "line_id"], "left").join(pages.select(*PAGE, "height"), PAGE).withColumn("own_size", stats.line_font_size(F.col("spans")))
    free = F.col("edge").isNull()
    page = Window.partitionBy(*PAGE)
    banded = free & F.col("bbox.y0").between(F.col("height") * BODY_BAND[0], F.col("height") * BODY_BAND[1]) & F.col("own_size").between(*BODY_SIZES)
    rows = rows.withColumn("body_size", F.coalesce(F.median(F.when(banded, F.col("own_size"))).over(page), F.lit(DEFAULT_SIZE)))
    rows = rows.withColumn("size", F.when(F.col("own_size") > 0, F.col("own_size")).otherwise(F.col("body_size")))
    upwards = Window.partitionBy(*PAGE).orderBy(F.desc("bbox.y0"), F.desc("line_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("under", F.max(F.when(free, F.col("size"))).over(upwards))
    raised = F.coalesce(F.get("spans", F.lit(0))["superscript"], F.lit(False))
    label = free & T.label_prefix(F.col("text")).isNotNull() & (F.col("size") <= F.col("body_size") * LARGE_LABEL) & (F.col("bbox.y0") < F.col("height") * LAST_LABEL)
    starts = label & ((F.col("size") <= F.col("body_size") * LABEL_SIZE) | raised) & (F.col("under") <= F.col("body_size") * UNDER_SIZE) & (F.col("bbox.y0") >= F.col("height") * NOTE_TOP)
    cuts = rows.groupBy(*PAGE).agg(F.min(F.when(starts, F.col("bbox.y0"))).alias("cut"))
    if separators is not None:
        cuts = cuts.join(separators.select(*PAGE, "separator_y"), PAGE, "left").select(*PAGE, F.coalesce("separator_y", "cut").alias("cut"))
    before = Window.partitionBy("doc_id").orderBy("page_index")
    cuts = cuts.withColumn("continued", F.lag(F.col("cut").isNotNull()).over(before) & (F.lag("page_index").over(before) == F.col("page_index") - 1))
    met = rows.join(cuts, PAGE)
    below = F.col("bbox.y0") >= F.col("cut") - F.greatest(F.col("height") * 0.004, F.lit(1.0))
    goes_on = F.col("cut").isNull() & F.coalesce("continued", F.lit(False)) & (F.col("under") <= F.col("body_size") * LABEL_SIZE) & (F.col("bbox.y0") >= F.col("height") * CONTINUED_TOP)
    heading = S.heading_style(F.col("text")) | ((F.col("size") >= F.col("body_size") * HEADING_SIZE) & title_plausible(F.col("text")))
    region = F.when(~free, F.col("edge")).when(F.coalesce(below, F.lit(False)) | goes_on, "footnote").when(F.coalesce(heading, F.lit(False)), "heading").otherwise("body")
    order = Window.partitionBy(*PAGE).orderBy("reading_order", "line_id")
    named = met.withColumn("region_type", region)
    gap = F.col("bbox.y0") - F.lag("bbox.y1").over(order)
    new = F.coalesce((F.lag("region_type").over(order) != F.col("region_type")) | (gap > G.height(F.col("bbox")) * BLOCK_GAP) | (F.col("bbox.y0") < F.lag("bbox.y0").over(order)), F.lit(True))
    blocks = named.withColumn("new_block", new.cast("int")).withColumn("block_index", (F.sum("new_block").over(order) - 1).cast("int"))
    kept = [c for c in lines.columns if c not in ("region_type", "block_index", "page_number")]
    return blocks.join(pages.select(*PAGE, "page_number"), PAGE).select(*kept, "page_number", "region_type", "block_index")
