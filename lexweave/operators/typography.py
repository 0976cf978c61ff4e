"""What the type and place of lines say: raised labels, bold shares, prose that runs on, references that wrap.

A line is held against the other lines of its page only, so every join here is bounded by a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import geometry as G
from lexweave.functions import shapes as S
from lexweave.functions import stats
from lexweave.functions import text as T

# --- Fixed values -----------------------------------------------------------------------------------

SMALL_LABEL, LABEL_FACTOR, LABEL_RISE = 0.75, 1.25, 0.25
BOLD_FLAG, BOLD_NAME = 16, "bold"
WAITING_NOUNS = ("c", "ch", "s", "ss", "art", "arts")
SAME_TYPE, WRAP_OVERLAP, WRAP_GAP = 0.5, 0.5, 0.6
PROSE_OVERLAP, PROSE_GAP, FULL_MARGIN = 0.25, 0.5, 0.1
LONG_WORDS = 8
NEIGHBOUR_LEFT, NEIGHBOUR_OVERLAP, NEIGHBOUR_GAP, NEIGHBOUR_LEAST, NEIGHBOUR_HEIGHTS = 10.0, 0.5, 1.4, 14.0, (0.75, 1.35)
WARBLE_SHARE = 0.65

# ----------------------------------------------------------------------------------------------------

PAGE = ["doc_id", "page_index"]
_PREFIX = r"^(\s*)([" + T.NOTE_SYMBOLS + r"]{1,8}|[0-9]{1,4})"


def bold_share(spans: Column) -> Column:
    """Share of the characters of spans whose flags or font name say bold; 0 without characters."""
    chars = lambda s: F.length(F.coalesce(s["text"], F.lit("")))
    bold = lambda s: F.coalesce((s["flags"].bitwiseAND(F.lit(BOLD_FLAG)) != 0) | F.lower(s["font"]).contains(BOLD_NAME), F.lit(False))
    total = F.aggregate(spans, F.lit(0), lambda acc, s: acc + chars(s))
    heavy = F.aggregate(spans, F.lit(0), lambda acc, s: acc + F.when(bold(s), chars(s)).otherwise(0))
    return F.when(F.coalesce(total, F.lit(0)) > 0, heavy / total).otherwise(F.lit(0.0))


def label_spans(text: Column, spans: Column) -> Column:
    """The spans under the note label that a line starts with."""
    start = F.length(F.regexp_extract(text, _PREFIX, 1))
    end = start + F.length(F.regexp_extract(text, _PREFIX, 2))
    return F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def raised_labels(lines: DataFrame) -> DataFrame:
    """Lines that start with a note label: whether it is set above or smaller than its line, and than the body.

    lines: doc_id, page_index, line_id, text, bbox, spans, body_size. Rows: label, raised, typographic.
    """
    size = stats.line_font_size(F.col("spans"))
    rows = lines.withColumns({"label": T.label_prefix(F.col("text")), "size": size, "under": label_spans(F.col("text"), F.col("spans"))}).where("label is not null")
    high = G.height(F.col("bbox"))
    sized = lambda s: (F.col("size") > 0) & (s["size"] > 0)
    lifted = lambda s: (s["size"] * LABEL_FACTOR <= F.col("size")) & (high > 0) & (s["bbox"]["y1"] <= F.col("bbox.y1") - LABEL_RISE * high)
    raised = F.coalesce(F.exists("under", lambda s: s["superscript"] | (sized(s) & ((s["size"] <= F.col("size") * SMALL_LABEL) | lifted(s)))), F.lit(False))
    least = F.coalesce(F.array_min(F.transform(F.filter("under", lambda s: s["size"] > 0), lambda s: s["size"])), F.col("size"))
    return rows.select(*PAGE, "line_id", "label", raised.alias("raised"), (raised | ((least > 0) & (least <= F.col("body_size") * SMALL_LABEL))).alias("typographic"))


def _above(lines: DataFrame, near: Column, rank: list[str]) -> DataFrame:
    """Each line with the lowest line above it that meets a condition; of equally low ones the last in order."""
    names = ("line_id", "text", "bbox", "size", "region_type", "place", "excluded")
    other = lines.select(*PAGE, F.struct(*[n for n in names if n in lines.columns]).alias("above"))
    met = lines.join(other, PAGE).where((F.col("above.line_id") != F.col("line_id")) & near)
    return met.groupBy(*PAGE, "line_id").agg(F.max_by("above", F.struct(*rank)).alias("above"))


def wrapped_references(lines: DataFrame) -> DataFrame:
    """Lines onto which a reference wraps: the line just above, in their type, ends on a noun that waits for its number.

    lines: doc_id, page_index, line_id, reading_order, text, bbox, size.
    """
    rows = lines.select(*PAGE, "line_id", "text", "bbox", "size", F.col("reading_order").alias("place"))
    height = G.height(F.col("bbox"))
    across = (F.col("above.bbox.x0") < F.col("bbox.x1")) & (F.col("bbox.x0") < F.col("above.bbox.x1"))
    near = (F.abs(F.col("above.size") - F.col("size")) <= SAME_TYPE) & (F.col("above.bbox.y1") <= F.col("bbox.y0") + height * WRAP_OVERLAP) & (F.col("bbox.y0") - F.col("above.bbox.y1") < height * WRAP_GAP) & across
    found = _above(rows, near, ["above.bbox.y1", "above.place"])
    last = F.regexp_replace(F.regexp_extract("above.text", r"(\S+)\s*$", 1), r"\.+$", "")
    return found.where(last.isin(*WAITING_NOUNS)).select(*PAGE, "line_id", F.col("above.line_id").alias("above_id"))


def column_extents(lines: DataFrame) -> DataFrame:
    """Each body line with the left and right end of the body lines of its page that it overlaps across."""
    body = lines.where("region_type = 'body'")
    other = body.select(*PAGE, F.col("bbox").alias("o"))
    met = lines.join(other, PAGE).where((F.col("o.x0") < F.col("bbox.x1")) & (F.col("bbox.x0") < F.col("o.x1")))
    return met.groupBy(*PAGE, "line_id").agg(F.least(F.min("o.x0"), F.min("bbox.x0")).alias("left"), F.greatest(F.max("o.x1"), F.max("bbox.x1")).alias("right"))


def prose_continuations(lines: DataFrame) -> DataFrame:
    """Lines that carry on the body line above: it reaches its column's right end at their leading and ends no sentence.

    lines: doc_id, page_index, line_id, reading_order, text, bbox, region_type, exclude_from_body.
    """
    rows = lines.select(*PAGE, "line_id", "text", "bbox", "region_type", F.col("reading_order").alias("place"), F.coalesce("exclude_from_body", F.lit(False)).alias("excluded"))
    height = G.height(F.col("bbox"))
    near = (F.col("above.region_type") == "body") & ~F.col("above.excluded") & (F.col("above.bbox.y1") <= F.col("bbox.y0") + height * PROSE_OVERLAP) & (F.col("above.bbox.x0") < F.col("bbox.x1")) & (F.col("bbox.x0") < F.col("above.bbox.x1"))
    found = _above(rows, near, ["above.bbox.y1", "above.place"])
    extents = column_extents(rows).withColumnRenamed("line_id", "above_id")
    met = found.withColumn("above_id", F.col("above.line_id")).join(extents, [*PAGE, "above_id"]).join(rows.select(*PAGE, "line_id", "bbox"), [*PAGE, "line_id"])
    text = F.rtrim("above.text")
    full = F.col("above.bbox.x1") >= F.col("right") - (F.col("right") - F.col("left")) * FULL_MARGIN
    close = F.col("bbox.y0") - F.col("above.bbox.y1") < height * PROSE_GAP
    opener = S.is_shape("standalone_enumerator", text) | S.is_shape("inline_enumerator", text)
    return met.where((height > 0) & full & close & ~S.is_shape("sentence_ended", text) & ~text.rlike("[:”\"]$") & ~opener).select(*PAGE, "line_id", "above_id")


def caps_warble(text: Column) -> Column:
    """Mostly capitals with lower case among them, as damaged capitals read."""
    own = S.letters(text)
    upper = F.length(F.regexp_replace(own, r"[^\p{Lu}]", ""))
    return F.coalesce((upper > 0) & own.rlike(r"\p{Ll}") & (upper / F.length(own) >= WARBLE_SHARE), F.lit(False))


def heading_evidence(lines: DataFrame) -> DataFrame:
    """For each line: whether body lines at its left and leading stand on both sides, and whether it reads as damaged capitals."""
    order = Window.partitionBy(*PAGE).orderBy("reading_order", "line_id")
    side = F.struct("bbox", "region_type")
    seen = lines.select(*PAGE, "line_id", "text", "bbox", F.lag(side).over(order).alias("before"), F.lead(side).over(order).alias("after"))
    height = F.greatest(G.height(F.col("bbox")), F.lit(1.0))

    def beside(name: str, gap: Column) -> Column:
        other = F.col(name)
        ratio = height / F.greatest(G.height(other["bbox"]), F.lit(1.0))
        fits = (F.abs(F.col("bbox.x0") - other["bbox"]["x0"]) <= NEIGHBOUR_LEFT) & (gap >= -height * NEIGHBOUR_OVERLAP) & (gap <= F.greatest(height * NEIGHBOUR_GAP, F.lit(NEIGHBOUR_LEAST))) & ratio.between(*NEIGHBOUR_HEIGHTS)
        return F.coalesce((other["region_type"] == "body") & fits, F.lit(False))

    both = beside("before", F.col("bbox.y0") - F.col("before.bbox.y1")) & beside("after", F.col("after.bbox.y0") - F.col("bbox.y1"))
    return seen.select(*PAGE, "line_id", both.alias("between_body"), caps_warble(F.col("text")).alias("warble"))
