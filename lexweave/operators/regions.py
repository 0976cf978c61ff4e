"""Regions, paragraphs, text offsets, and joins of lines with regions and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import geometry as G
from lexweave.functions import stats
from lexweave.functions import text as T

#: Characters of text in a bin of the interval join.
BIN = 2048


def page_order() -> Window:
    return Window.partitionBy("doc_id", "page_index").orderBy("reading_order", "line_id")


def region_islands(lines: DataFrame) -> DataFrame:
    """Runs of lines of one region type and block, in reading order: a row for each with its box and lines."""
    order = page_order()
    starts = ~(F.col("region_type").eqNullSafe(F.lag("region_type").over(order)) & F.col("block_index").eqNullSafe(F.lag("block_index").over(order)))
    numbered = lines.withColumn("region_no", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(order))
    return numbered.groupBy("doc_id", "page_index", "region_no").agg(
        F.first("region_type").alias("kind"),
        F.first("block_index").alias("block_index"),
        stats.union_box(F.col("bbox")).alias("bbox"),
        F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "line_id"))), lambda x: x["line_id"]).alias("line_ids"),
    )


def paragraphs(lines: DataFrame) -> DataFrame:
    """Body and heading regions as running text, numbered through the document."""
    order = page_order()
    starts = ~(F.col("region_type").eqNullSafe(F.lag("region_type").over(order)) & F.col("block_index").eqNullSafe(F.lag("block_index").over(order)))
    numbered = lines.withColumn("region_no", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(order))
    body = numbered.where(F.col("region_type").isin("body", "heading") & ~F.coalesce("exclude_from_body", F.lit(False)))
    listed = body.groupBy("doc_id", "page_index", "region_no").agg(F.first("region_type").alias("region_type"), F.array_sort(F.collect_list(F.struct("reading_order", "line_id", "text"))).alias("ls"))
    told = listed.select("doc_id", "page_index", "region_no", "region_type", T.joined_lines(F.transform("ls", lambda x: x["text"])).alias("text"), F.transform("ls", lambda x: x["line_id"]).alias("line_ids")).where("text <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "region_no"))
    return told.select("doc_id", F.format_string("para-%06d", number).alias("paragraph_id"), number.alias("ordinal"), "page_index", "region_type", "text", "line_ids")


def text_index(lines: DataFrame) -> DataFrame:
    """Character range of each line in the document's text, lines joined by one character."""
    before = Window.partitionBy("doc_id").orderBy("page_index", "reading_order", "line_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return lines.select("doc_id", "page_index", "line_id", start.alias("start"), (start + F.length("text")).alias("end"))


def utf16_index(units: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: str = "seq", text: str = "text") -> DataFrame:
    """UTF-16 range of each unit in a rendered text, units joined by one character."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(T.utf16_length(F.col(text)) + 1).over(before), F.lit(0))
    return units.select(*keys, order, start.alias("start"), (start + T.utf16_length(F.col(text))).alias("end"))


def overlapping(ranges: DataFrame, index: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Lines of an index that overlap ranges (doc_id, range_id, from_char, to_char): an equi-join on bins.

    Ranges and lines are put into every bin they touch; a pair is kept in the first bin that both touch.
    """
    spans = lambda a, b: F.sequence(F.floor(a / bin_size), F.floor((F.greatest(b, a + 1) - 1) / bin_size))
    r = ranges.withColumn("bin", F.explode(spans(F.col("from_char"), F.col("to_char"))))
    i = index.withColumn("bin", F.explode(spans(F.col("start"), F.col("end"))))
    met = r.join(i, ["doc_id", "bin"]).where((F.col("start") < F.col("to_char")) & (F.col("from_char") < F.col("end")))
    return met.where(F.col("bin") == F.greatest(F.floor(F.col("start") / bin_size), F.floor(F.col("from_char") / bin_size))).drop("bin")


def range_of_lines(claims: DataFrame, index: DataFrame) -> DataFrame:
    """For claims (doc_id, claim_id, line_ids): first start, last end, pages, and the lines not found."""
    each = claims.select("doc_id", "claim_id", F.explode("line_ids").alias("line_id"))
    met = each.join(index, ["doc_id", "line_id"], "left")
    return met.groupBy("doc_id", "claim_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("page_index")).alias("page_indexes"), F.count_if(F.col("start").isNull()).alias("missing")
    )


def assign_regions(lines: DataFrame, regions: DataFrame, least_overlap: float = 0.1) -> DataFrame:
    """The region of each line: the smallest that contains it, else the one that covers most of it, a tenth at least."""
    named = regions.select("doc_id", "page_index", "region_id", F.col("bbox").alias("region_box"))
    pairs = lines.where(G.is_valid(F.col("bbox"))).join(named, ["doc_id", "page_index"])
    share = G.intersection(F.col("bbox"), F.col("region_box")) / G.area(F.col("bbox"))
    inside = G.contains(F.col("region_box"), F.col("bbox"))
    rank = F.struct(F.when(inside, 0).otherwise(1), F.when(inside, G.area(F.col("region_box"))).otherwise(-share), F.col("region_id"))
    return pairs.where(inside | (share >= least_overlap)).groupBy("doc_id", "page_index", "line_id").agg(F.min_by("region_id", rank).alias("region_id"))


def region_contexts(assigned: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines, characters and text of each region."""
    joined = assigned.join(lines.select("doc_id", "page_index", "line_id", "reading_order", "text"), ["doc_id", "page_index", "line_id"])
    told = joined.groupBy("doc_id", "page_index", "region_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.array_sort(F.collect_list(F.struct("reading_order", "text"))).alias("ls"))
    return told.select("doc_id", "page_index", "region_id", "n_lines", "n_chars", F.array_join(F.transform("ls", lambda x: x["text"]), " ").alias("text"))


def nearest_label(labels: DataFrame, bodies: DataFrame) -> DataFrame:
    """For each note label the line beside it: not left of it, sharing half of the lower height; least gap, then drop."""
    from lexweave.functions.shapes import is_shape

    b = bodies.where(~is_shape("note_label_alone", F.col("text"))).select("doc_id", "page_index", F.col("line_id").alias("body_id"), F.col("bbox").alias("body_box"))
    met = labels.join(b, ["doc_id", "page_index"]).where(F.col("line_id") != F.col("body_id"))
    shared = F.least(F.col("bbox.y1"), F.col("body_box.y1")) - F.greatest(F.col("bbox.y0"), F.col("body_box.y0"))
    lower = F.least(G.height(F.col("bbox")), G.height(F.col("body_box")))
    gap = F.greatest(F.col("body_box.x0") - F.col("bbox.x1"), F.lit(0.0))
    down = F.abs(F.col("body_box.y0") - F.col("bbox.y0"))
    near = met.where((F.col("body_box.x0") >= F.col("bbox.x0")) & (shared > 0) & (lower > 0) & (shared / lower >= 0.5))
    return near.groupBy("doc_id", "page_index", "line_id").agg(F.min_by("body_id", F.struct(gap, down, F.col("body_id"))).alias("body_id"))


def outline_parents(headings: DataFrame) -> DataFrame:
    """parent_id of each heading: the nearest earlier one of a lower level. Levels are few, so each is a last value."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.struct("seq", "node_id")), True).over(before).alias(f"l{k}") for k in range(1, 6)]
    seen = headings.select("*", *last)
    lower = F.array_max(F.filter(F.array(*[F.when(F.lit(k) < F.col("level"), F.col(f"l{k}")) for k in range(1, 6)]), lambda s: s.isNotNull()))
    return seen.select(*headings.columns, lower["node_id"].alias("parent_id"))


def hyphen_faults(lines: DataFrame) -> DataFrame:
    """Lines that end in a word fragment: a fault where the next line of another region goes on, else dangling."""
    from lexweave.functions.shapes import is_shape

    order = Window.partitionBy("doc_id").orderBy("page_index", "reading_order", "line_id")
    seen = lines.select("doc_id", "page_index", "line_id", "region_type", "text", F.lead("text").over(order).alias("next_text"), F.lead("region_type").over(order).alias("next_region"))
    goes_on = is_shape("hyphen_head", F.col("next_text"))
    kind = F.when(goes_on & (F.col("next_region") != F.col("region_type")), "REGION_BOUNDARY_FAULT").when(~F.coalesce(goes_on, F.lit(False)), "DANGLING_SOFT_HYPHEN")
    return seen.where(is_shape("hyphen_tail", F.trim("text"))).select("doc_id", "page_index", "line_id", kind.alias("code")).where("code is not null")


