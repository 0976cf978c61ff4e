"""Exact lookup of pages, paragraphs, notes and sections: requests joined to units, with a status for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import locators as L
from lexweave.functions import text as T
from lexweave.storage import stored

# --- Fixed values -----------------------------------------------------------------------------------

KINDS = ("page", "paragraph", "footnote", "section", "article", "chapter", "clause", "part", "rule", "schedule", "subsection")
MOST_CONTEXT, MOST_UNITS, MOST_CHARS, LONGEST_LOCATOR = 2, 20, 60_000, 200

# ----------------------------------------------------------------------------------------------------


def is_valid(kind: Column, locator: Column, context: Column, page: Column, occurrence: Column) -> Column:
    """A known kind, a locator that is not blank and not long, little context, positive page and occurrence."""
    positive = lambda c: c.isNull() | (c > 0)
    return F.coalesce(kind.isin(*KINDS), F.lit(False)) & F.coalesce((F.trim(locator) != "") & (T.utf16_length(locator) <= LONGEST_LOCATOR), F.lit(False)) & F.coalesce(context, F.lit(0)).between(0, MOST_CONTEXT) & positive(page) & positive(occurrence)


def lookup(units: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers requests about a document's units.

    units: doc_id, kind (page, paragraph, footnote, section), ordinal (from 1 in its kind), unit_id, label
    (a page's number, a note's label, a section's label), aliases, locator_kind, occurrence, pages, text.
    requests: request_id, doc_id, kind, locator, end_locator, context, page, occurrence.

    One row for each request: status (found, not_found, ambiguous, invalid, unavailable), matches, before,
    selected and after (texts in order). Requests are normalised to numbers or keys, joined by equality, and
    only found ranges fetch their units. Units and requests are stored once: the key index reads the units' narrow
    columns, and texts are read for found ranges alone.
    """
    plain = lambda c: L.compatible(F.col(c))
    units = stored(units.select("*", plain("label").alias("plain_label"), F.when(F.col("kind") == "section", F.transform("aliases", L.compatible)).alias("plain_aliases"), F.when(F.col("kind") == "section", plain("unit_id")).alias("plain_id")), "units")
    group = F.when(F.col("kind").isin("page", "paragraph", "footnote"), F.col("kind")).otherwise("section")
    end = F.when(F.col("end_locator") != "", F.col("end_locator"))
    asked = requests.select("*", group.alias("unit_kind"), end.alias("end"), plain("locator").alias("plain_from"), L.compatible(end).alias("plain_to"), is_valid(F.col("kind"), F.col("locator"), F.col("context"), F.col("page"), F.col("occurrence")).alias("valid"))
    asked = stored(asked, "requests")
    asked = asked.withColumns({"span": L.plain_range(F.col("kind"), F.col("plain_from")), "alone": L.plain_ordinal(F.col("kind"), F.col("plain_from")), "upto": L.plain_ordinal(F.col("kind"), F.col("plain_to"))})
    first = F.coalesce("span.first", "alone")
    last = F.when(F.col("end").isNotNull(), F.col("upto")).otherwise(F.coalesce("span.last", first))
    # Stored once more, so that what follows holds the numbers and not the patterns that they come from.
    asked = stored(asked.withColumns({"first": first, "last": last}).drop("span", "alone", "upto"), "asked")
    numbered = F.col("unit_kind").isin("page", "paragraph")
    bad = ~F.col("valid") | (numbered & F.coalesce((F.col("first") > F.col("last")) | F.col("first").isNull() | F.col("last").isNull(), F.lit(True))) | ((F.col("unit_kind") == "section") & F.col("end").isNotNull())
    asked = asked.withColumn("bad", F.coalesce(bad, F.lit(True)))

    key = F.when(F.col("kind") == "footnote", L.footnote_key(F.col("label"))).when(F.col("kind") == "section", L.plain_section_key(F.col("plain_label"))).when(F.col("kind") == "page", F.col("label")).otherwise(F.col("ordinal").cast("string"))
    other = F.when(F.col("kind") == "section", F.transform(F.coalesce("plain_aliases", F.array()), L.plain_section_key)).when(F.col("kind") == "footnote", F.array(L.footnote_key(F.col("unit_id")))).otherwise(F.array().cast("array<string>"))
    ids = F.when(F.col("kind") == "section", F.array(L.plain_section_key(F.concat(F.lit("section:"), F.col("plain_id"))))).otherwise(F.array().cast("array<string>"))
    keyed = units.select(F.col("doc_id"), F.col("kind").alias("unit_kind"), "ordinal", "unit_id", "locator_kind", F.col("occurrence").alias("unit_occurrence"), "pages", F.explode(F.array_distinct(F.concat(F.array(key), other, ids))).alias("key"))

    def wanted(locator: Column, plain_form: Column, number: Column) -> Column:
        return F.when(numbered, number.cast("string")).when(F.col("unit_kind") == "footnote", L.footnote_key(locator)).otherwise(L.plain_section_key(plain_form))

    good = asked.where("not bad")
    sides = good.select("request_id", "doc_id", "kind", "unit_kind", "page", "occurrence", F.explode(F.array(F.struct(F.lit("from").alias("side"), wanted(F.col("locator"), F.col("plain_from"), F.col("first")).alias("key")), F.struct(F.lit("to").alias("side"), wanted(F.coalesce("end", "locator"), F.coalesce("plain_to", "plain_from"), F.col("last")).alias("key")))).alias("s")).select("*", "s.side", "s.key")
    met = sides.drop("s").join(keyed, ["doc_id", "unit_kind", "key"])
    fits = F.when(F.col("unit_kind") == "footnote", (F.col("occurrence").isNull() | (F.col("occurrence") == F.col("unit_occurrence"))) & (F.col("page").isNull() | F.array_contains("pages", F.col("page")))).when(F.col("unit_kind") == "section", (F.col("kind") == "section") | (F.col("kind") == F.col("locator_kind"))).otherwise(F.lit(True))
    met = met.where(fits)
    found = met.groupBy("request_id").agg(
        F.countDistinct(F.when(F.col("side") == "from", F.col("unit_id"))).alias("n_from"),
        F.countDistinct(F.when(F.col("side") == "to", F.col("unit_id"))).alias("n_to"),
        F.min(F.when(F.col("side") == "from", F.col("ordinal"))).alias("start"),
        F.min(F.when(F.col("side") == "to", F.col("ordinal"))).alias("stop"),
        F.array_sort(F.collect_set(F.struct("ordinal", "unit_id"))).alias("hits"),
    )
    kinds = units.where("kind = 'section' and locator_kind is not null").select("doc_id", F.col("locator_kind").alias("kind"), F.lit(True).alias("has_kind")).distinct()
    state = asked.join(found, "request_id", "left").join(kinds, ["doc_id", "kind"], "left")
    absent = (F.col("unit_kind") == "section") & (F.col("kind") != "section") & F.col("has_kind").isNull()
    status = (
        F.when(F.col("bad"), "invalid")
        .when(absent, "unavailable")
        .when((F.coalesce("n_from", F.lit(0)) > 1) | (F.coalesce("n_to", F.lit(0)) > 1), "ambiguous")
        .when((F.coalesce("n_from", F.lit(0)) == 0) | (F.coalesce("n_to", F.lit(0)) == 0) | (F.col("stop") < F.col("start")), "not_found")
        .when(F.col("stop") - F.col("start") + 1 > MOST_UNITS, "invalid")
        .otherwise("found")
    )
    state = state.withColumn("status", status)
    reach = state.where("status = 'found'").select("request_id", "doc_id", "unit_kind", "start", "stop", F.explode(F.sequence(F.col("start") - F.coalesce("context", F.lit(0)), F.col("stop") + F.coalesce("context", F.lit(0)))).alias("ordinal"))
    texts = units.select("doc_id", F.col("kind").alias("unit_kind"), "ordinal", "unit_id", "text")
    got = reach.join(texts, ["doc_id", "unit_kind", "ordinal"])
    part = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ordinal", "unit_id", "text")))), lambda x: x["text"])
    within = F.col("ordinal").between(F.col("start"), F.col("stop"))
    told = got.groupBy("request_id").agg(
        part(F.col("ordinal") < F.col("start")).alias("before"),
        part(within).alias("selected"),
        part(F.col("ordinal") > F.col("stop")).alias("after"),
        F.transform(F.array_sort(F.collect_list(F.when(within, F.struct("ordinal", "unit_id")))), lambda x: x["unit_id"]).alias("unit_ids"),
        F.sum(T.utf16_length(F.col("text"))).alias("chars"),
        F.count_if(within & (F.coalesce("text", F.lit("")) == "")).alias("blank"),
    )
    done = state.join(told, "request_id", "left")
    final = F.when((F.col("status") == "found") & (F.col("blank") > 0), "unavailable").when((F.col("status") == "found") & (F.col("chars") > MOST_CHARS), "invalid").otherwise(F.col("status"))
    none = F.array().cast("array<string>")
    keep = lambda c: F.when(F.col("final") == "found", F.col(c)).otherwise(none)
    done = done.withColumn("final", final)
    matches = F.when(F.col("final") == "found", F.col("unit_ids")).when(F.col("final") == "ambiguous", F.transform("hits", lambda h: h["unit_id"])).otherwise(none)
    return done.select("request_id", "doc_id", F.col("final").alias("status"), matches.alias("matches"), keep("before").alias("before"), keep("selected").alias("selected"), keep("after").alias("after"))


def page_passages(native: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages (doc_id, page_index, lines) with those of the recogniser where the native ones are empty."""
    other = recognised.select("doc_id", "page_index", F.col("lines").alias("ocr_lines"))
    met = native.join(other, ["doc_id", "page_index"], "left")
    use = (F.size("lines") == 0) & F.col("ocr_lines").isNotNull()
    return met.select("doc_id", "page_index", F.when(use, F.col("ocr_lines")).otherwise(F.col("lines")).alias("lines"), F.when(use, "ocr").otherwise("native").alias("source"))


def rendered_ranges(units: DataFrame) -> DataFrame:
    """Units of a document in rendered order with their UTF-16 ranges and the digest of the whole text."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    start = F.coalesce(F.sum(T.utf16_length(F.col("text")) + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = units.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n"), 256).alias("revision"))
    return units.select("doc_id", "seq", start.alias("rendered_start"), (start + T.utf16_length(F.col("text"))).alias("rendered_end")).join(whole, "doc_id")


# --- Units of a document ------------------------------------------------------------------------------

_SCORE = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c).cast("double")))


def page_units(pages: DataFrame) -> DataFrame:
    """Units of pages (doc_id, page_id, page_number, text_quality, source, text); the quality is the confidence."""
    unit_id = F.when(F.coalesce("page_id", F.lit("")) == "", F.concat(F.lit("page-"), F.col("page_number").cast("string"))).otherwise(F.col("page_id"))
    source = F.when(F.coalesce("source", F.lit("")) == "", "unknown").otherwise(F.col("source"))
    number = F.col("page_number").cast("int")
    return pages.select("doc_id", F.lit("page").alias("kind"), unit_id.alias("unit_id"), F.format_string("[page %d]", number).alias("locator"), F.coalesce("text", F.lit("")).alias("text"), F.array(number).alias("pages"), _SCORE("text_quality").alias("confidence"), F.lit("page_text_quality").alias("basis"), source.alias("provenance"))


def paragraph_units(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Units of paragraphs (doc_id, paragraph_id, ordinal, page_index, region_type, text); confidence is that of the first page."""
    first = pages.select("doc_id", "page_index", F.col("page_number").cast("int").alias("number"), _SCORE("text_quality").alias("confidence"))
    met = paragraphs.join(first, ["doc_id", "page_index"], "left")
    number = F.col("ordinal").cast("string")
    unit_id = F.when(F.coalesce("paragraph_id", F.lit("")) == "", F.concat(F.lit("paragraph-"), number)).otherwise(F.col("paragraph_id"))
    told = F.col("number").isNotNull()
    return met.select("doc_id", F.lit("paragraph").alias("kind"), unit_id.alias("unit_id"), F.concat(F.lit("paragraph "), number).alias("locator"), "text", F.when(told, F.array("number")).otherwise(F.array().cast("array<int>")).alias("pages"), "confidence", F.when(told, "page_text_quality").otherwise("unavailable").alias("basis"), F.concat(F.lit("legalpdf:"), F.when(F.col("region_type").isin("body", "heading"), F.col("region_type")).otherwise("unknown")).alias("provenance"))


def footnote_units(notes: DataFrame) -> DataFrame:
    """Units of notes (doc_id, pair_id, label, body, reference_page, body_pages, confidence, provenance, sentence, passage)."""
    pages = F.array_distinct(F.filter(F.concat(F.array(F.col("reference_page").cast("int")), F.col("body_pages").cast("array<int>")), lambda p: p.isNotNull()))
    source = F.when(F.coalesce("provenance", F.lit("")) == "", "unknown").otherwise(F.col("provenance"))
    return notes.select("doc_id", F.lit("footnote").alias("kind"), F.col("pair_id").alias("unit_id"), F.concat(F.lit("footnote "), F.col("label")).alias("locator"), F.trim("body").alias("text"), pages.alias("pages"), _SCORE("confidence").alias("confidence"), F.lit("footnote_pairing").alias("basis"), source.alias("provenance"), F.trim("sentence").alias("sentence"), F.trim("passage").alias("passage"))


def section_units(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Units of sections (doc_id, seq, section_id, label, page_indexes, text): their pages in order, the least quality as confidence."""
    known = pages.select("doc_id", "page_index", F.col("page_number").cast("int").alias("number"), _SCORE("text_quality").alias("quality"))
    each = sections.select("doc_id", "seq", F.posexplode("page_indexes").alias("pos", "page_index")).join(known, ["doc_id", "page_index"])
    told = each.groupBy("doc_id", "seq").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda x: x["number"])).alias("pages"), F.min("quality").alias("confidence"))
    unit_id = F.when(F.coalesce("section_id", F.lit("")) == "", F.concat(F.lit("section-"), F.col("seq").cast("string"))).otherwise(F.col("section_id"))
    met = sections.join(told, ["doc_id", "seq"], "left")
    return met.select("doc_id", F.lit("section").alias("kind"), unit_id.alias("unit_id"), F.trim(F.coalesce("label", "section_id")).alias("locator"), F.trim("text").alias("text"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"), "confidence", F.when(F.col("confidence").isNull(), "unavailable").otherwise("minimum_page_text_quality").alias("basis"))
