"""From texts and page lines to the statute's line stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import patterns as P


def text_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Trimmed non-empty lines of plain texts, in order, on page 1."""
    cut = df.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line"))
    return cut.select("doc_id", F.col("pos").alias("seq"), F.trim("line").alias("text"), F.lit(1).alias("page_number"), F.lit("unknown").alias("note_class")).where("text <> ''")


def broken_font(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and whether its quotation glyphs are mapped to bars; texts may be spread over rows."""
    count = lambda chars: F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"[{chars}]")))
    counted = docs.groupBy(F.col(doc).alias("doc_id")).agg(count(P.BAR).alias("bars"), count(P.DOUBLE_BAR).alias("doubles"), count(P.LEFT_QUOTE + P.RIGHT_QUOTE).alias("quotes"))
    rule = (F.col("doubles") > 0) & (F.col("bars") + F.col("doubles") >= P.BROKEN_FONT_HITS) & (F.col("quotes") * P.REAL_QUOTE_FACTOR <= F.col("bars"))
    return counted.select("doc_id", "bars", "doubles", "quotes", rule.alias("broken"))


def repaired(text: Column, broken: Column) -> Column:
    """Double bars are always closing quotes; bars are opening quotes only in a broken font."""
    closed = F.translate(text, P.DOUBLE_BAR, P.RIGHT_QUOTE)
    return F.when(broken, F.translate(closed, P.BAR, P.LEFT_QUOTE)).otherwise(closed)


def note_class(region_type: Column, note_region_mode: Column) -> Column:
    return F.when((region_type == "footnote") | (F.coalesce(note_region_mode, F.lit("")) != ""), "note").when(region_type == "body", "body").otherwise("unknown")


def furniture_key(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\p{Nl}]", ""))


def edge_furniture(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id and key of the texts that stand on enough pages to be running heads where they are at an edge."""
    keyed = lines.select("doc_id", "page_index", furniture_key(F.col("text")).alias("key")).where("key <> ''")
    return keyed.groupBy("doc_id", "key").agg(F.countDistinct("page_index").alias("pages")).where(F.col("pages") >= P.EDGE_PAGES)


def marked(text: Column, spans: Column) -> Column:
    """The text with superscript digit spans put in brackets, from the right, unless they already are."""
    digits = F.filter(spans, lambda s: s["superscript"] & s["text"].rlike("^[0-9]+$") & (s["start"] < s["end"]) & (s["end"] <= F.length(text)))
    ordered = F.reverse(F.array_sort(F.transform(digits, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))))

    def put(done: Column, s: Column) -> Column:
        before, after = F.substring(done, F.lit(1), s["start"]), F.substring(done, s["end"] + 1, F.length(done))
        bracketed = before.endswith("[") & after.startswith("]")
        return F.when(bracketed, done).otherwise(F.concat(before, F.lit("["), s["text"], F.lit("]"), after))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, text, put)).otherwise(text)


def statute_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, seq, text, page_number, note_class: page lines in reading order without excluded lines and furniture."""
    fonts = broken_font(lines).select("doc_id", "broken")
    heads = edge_furniture(lines, pages).select("doc_id", "key", F.lit(True).alias("repeats"))
    sized = pages.select("doc_id", "page_index", "width", "height")
    rows = lines.join(sized, ["doc_id", "page_index"]).withColumn("key", furniture_key(F.col("text"))).join(heads, ["doc_id", "key"], "left")
    edge = (F.col("width") > 0) & (F.col("height") > 0) & ((F.col("bbox.y1") < F.col("height") * P.EDGE_TOP) | (F.col("bbox.y0") > F.col("height") * P.EDGE_BOTTOM))
    keep = ~F.coalesce("exclude_from_body", F.lit(False)) & ~F.coalesce(F.col("region_type").isin("header", "footer"), F.lit(False)) & ~(edge & F.coalesce("repeats", F.lit(False))) & (F.trim("text") != "")
    kind = note_class(F.col("region_type"), F.col("note_region_mode"))
    text = F.when(kind == "note", F.trim("text")).otherwise(marked(F.col("text"), F.col("spans")))
    chosen = rows.where(keep).join(fonts, "doc_id").select(
        "doc_id",
        F.struct("page_index", "reading_order", "source_index").alias("seq"),
        repaired(text, F.col("broken")).alias("text"),
        "page_number",
        kind.alias("note_class"),
    )
    return chosen
