"""Running heads, folios and printed page labels, over pages and lines of all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import geometry as G
from lexweave.functions import shapes as S
from lexweave.functions import text as T

# --- Fixed values -----------------------------------------------------------------------------------

TOP_BAND, BOTTOM_BAND = 0.12, 0.90
MOST_WITNESSES, LEAST_WITNESSES, WITNESS_SHARE = 4, 2, 0.35
Y_TOLERANCE, X_TOLERANCE = 0.015, 0.04
FOLIO_PAGES, FOLIO_EDGE, FOLIO_BOTTOM = 4, 0.25, 0.92

# ----------------------------------------------------------------------------------------------------


def edge_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines in the top or bottom band with their normal text and their place as shares of the page."""
    sized = lines.join(pages.select("doc_id", "page_index", "page_number", "width", "height").where("width > 0 and height > 0"), ["doc_id", "page_index"])
    top = F.col("bbox.y1") < F.col("height") * TOP_BAND
    bottom = F.col("bbox.y0") > F.col("height") * BOTTOM_BAND
    rows = sized.where(top | bottom).select(
        "doc_id",
        "page_index",
        "page_number",
        "line_id",
        F.when(top, "top").otherwise("bottom").alias("edge"),
        T.furniture_normal(F.col("text")).alias("key"),
        (F.col("bbox.y0") / F.col("height")).alias("y"),
        (G.center_x(F.col("bbox")) / F.col("width")).alias("x"),
    )
    return rows.where("key <> ''")


def witnesses(pages: DataFrame) -> DataFrame:
    """doc_id and the number of pages that a repeated line must stand on."""
    least = F.least(F.lit(MOST_WITNESSES), F.greatest(F.lit(LEAST_WITNESSES), F.ceil(F.count("*") * WITNESS_SHARE)))
    return pages.groupBy("doc_id").agg(least.cast("int").alias("least"))


def repeated_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Edge lines whose text repeats at one height and, for pages of one parity, at one place across.

    Of the clusters of a text the one over the most pages counts. Every line starts a cluster of the lines
    at most a tolerance below it; inside it, per parity, the best run across is taken. Lines meet the starts of
    clusters in bins of a tolerance's height, their own and the one above, so that the work is that of the lines
    times the starts within two tolerances.
    """
    hits = edge_lines(lines, pages).withColumn("parity", F.col("page_number") % 2)
    keys = ["doc_id", "edge", "key"]
    band = F.floor(F.col("y") / Y_TOLERANCE)
    starts = hits.select(*keys, F.col("y").alias("start"), band.alias("band")).distinct()
    inside = hits.withColumn("band", F.explode(F.array(band, band - 1))).join(starts, [*keys, "band"]).drop("band").where((F.col("y") >= F.col("start")) & (F.col("y") - F.col("start") <= Y_TOLERANCE))
    # Ranges of windows are whole numbers: places are counted in millionths of the width.
    across = Window.partitionBy(*keys, "start", "parity").orderBy(F.round(F.col("x") * 1_000_000).cast("bigint")).rangeBetween(0, round(X_TOLERANCE * 1_000_000))
    counted = inside.withColumn("pages", F.size(F.collect_set("page_index").over(across)))
    best = counted.groupBy(*keys, "start", "parity").agg(F.max(F.struct("pages", "x")).alias("best"))
    chosen = inside.join(best, [*keys, "start", "parity"]).where((F.col("x") >= F.col("best.x")) & (F.col("x") - F.col("best.x") <= X_TOLERANCE))
    sizes = chosen.groupBy(*keys, "start").agg(F.countDistinct("page_index").alias("pages"))
    top = sizes.groupBy(*keys).agg(F.max(F.struct("pages", -F.col("start"))).alias("top")).select(*keys, (-F.col("top.col2")).alias("start"), F.col("top.pages").alias("pages"))
    kept = chosen.join(top, [*keys, "start"]).join(witnesses(pages), "doc_id").where("pages >= least")
    return kept.select("doc_id", "page_index", "line_id", "edge", "key", "pages").distinct()


def folio_runs(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Bottom numbers that rise by one with the page over at least four pages, in turn left and right or centred."""
    sized = lines.join(pages.select("doc_id", "page_index", "page_number", "width", "height").where("width > 0 and height > 0"), ["doc_id", "page_index"])
    x = G.center_x(F.col("bbox")) / F.col("width")
    side = F.when(x < FOLIO_EDGE, -1).when(x > 1 - FOLIO_EDGE, 1).when(F.abs(x - 0.5) <= X_TOLERANCE, 0)
    rows = sized.where(F.col("bbox.y0") > F.col("height") * FOLIO_BOTTOM).select("doc_id", "page_index", "page_number", "line_id", S.arabic_page_number(F.col("text")).alias("printed"), side.alias("side"), (F.col("bbox.y0") / F.col("height")).alias("y"), x.alias("x"))
    rows = rows.where("printed is not null and side is not null")
    alone = rows.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page_index"))).where("n = 1")
    order = Window.partitionBy("doc_id").orderBy("page_number")
    follows = (F.col("page_number") == F.lag("page_number").over(order) + 1) & (F.col("printed") == F.lag("printed").over(order) + 1) & F.when(F.col("side") == 0, F.lag("side").over(order) == 0).otherwise(F.col("side") == -F.lag("side").over(order))
    runs = alone.withColumn("starts", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("starts").over(order))
    spread = lambda c, t: (F.max(c) - F.min(c)) <= t
    even = runs.groupBy("doc_id", "run", (F.col("page_number") % 2).alias("parity")).agg(F.count("*").alias("n"), (spread("y", Y_TOLERANCE) & spread("x", X_TOLERANCE)).alias("aligned"))
    good = even.groupBy("doc_id", "run").agg(F.sum("n").alias("n"), F.bool_and("aligned").alias("aligned")).where((F.col("n") >= FOLIO_PAGES) & F.col("aligned"))
    return runs.join(good.select("doc_id", "run", F.col("n").alias("run_pages")), ["doc_id", "run"]).select("doc_id", "page_index", "line_id", "printed", "side", "run_pages")


def printed_labels(lines: DataFrame) -> DataFrame:
    """doc_id, page_index, printed_label, its source and line, n_labels: the footer's label first, none where labels differ."""
    label = S.printed_page_label(F.col("text"))
    rows = lines.where(F.col("region_type").isin("header", "footer")).select("doc_id", "page_index", "line_id", "region_type", "reading_order", label.alias("label")).where("label is not null")
    first = F.min(F.struct(F.col("region_type") != "footer", "reading_order", "label", "region_type", "line_id")).alias("first")
    found = rows.groupBy("doc_id", "page_index").agg(F.countDistinct(F.lower("label")).alias("n_labels"), first)
    only = lambda c: F.when(F.col("n_labels") == 1, F.col(f"first.{c}"))
    return found.select("doc_id", "page_index", only("label").alias("printed_label"), only("region_type").alias("printed_label_source"), only("line_id").alias("printed_label_line_id"), "n_labels")


def top_line_repeats(lines: DataFrame, depth: int = 4, pages: int = 2) -> DataFrame:
    """Keys among the first lines of a page that stand on several pages of the document."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("reading_order", "line_id")
    first = lines.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    return first.select("doc_id", "page_index", key.alias("key")).where("key <> ''").groupBy("doc_id", "key").agg(F.countDistinct("page_index").alias("pages")).where(F.col("pages") >= pages)


def page_offset(lines: DataFrame, votes: int = 3) -> DataFrame:
    """The most frequent difference of printed and physical page number of a document, with at least three votes."""
    number = S.arabic_page_number(F.col("text"))
    rows = lines.select("doc_id", (number - F.col("page_number")).alias("offset")).where("offset is not null")
    counted = rows.groupBy("doc_id", "offset").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)
    return counted.groupBy("doc_id").agg(F.max(F.struct("votes", -F.col("offset"))).alias("best")).select("doc_id", (-F.col("best.col2")).alias("offset"), "best.votes")


def region_repeats(regions: DataFrame, pages: DataFrame, least: int = 3, share: float = 0.4) -> DataFrame:
    """Texts of layout regions that stand on at least three pages and two fifths of a document's pages."""
    keyed = regions.select("doc_id", "page_index", S.repeat_text_key(F.col("text")).alias("key")).where("key <> ''")
    total = pages.groupBy("doc_id").agg(F.count("*").alias("total"))
    counted = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page_index").alias("pages"))
    return counted.join(total, "doc_id").where((F.col("pages") >= least) & (F.col("pages") >= F.col("total") * share)).select("doc_id", "key", "pages")


def is_edge(box: Column, page_height: Column) -> Column:
    return (box["y1"] < page_height * TOP_BAND) | (box["y0"] > page_height * BOTTOM_BAND)
