"""Corpus reports, document status, digests and integrity constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------

HARD_DIAGNOSTICS = ("COLUMN_ORDER_UNCERTAIN", "FOOTNOTE_UNMATCHED_LABEL", "FOOTNOTE_UNMATCHED_REFERENCE", "FOOTNOTE_REGION_UNCERTAIN", "TEXT_QUALITY_LOW")
OCR_REQUIRED = "OCR_REQUIRED"
MOST_SECONDS = 180
MANIFEST_PATH_CHARS = 1024
#: Stretches that latencies are cut into.
STRETCHES = 200

# ----------------------------------------------------------------------------------------------------


def status(pages: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """ocr_required where every page is, degraded after a hard warning, else ready."""
    size = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    ocr = F.col("code") == OCR_REQUIRED
    hard = F.col("severity").isin("warning", "error") & (ocr | F.col("code").isin(*HARD_DIAGNOSTICS))
    told = diagnostics.groupBy("doc_id").agg(F.countDistinct(F.when(ocr, F.coalesce("page_index", F.lit(-1)))).alias("ocr_pages"), F.bool_or(hard).alias("hard"))
    met = size.join(told, "doc_id", "left")
    return met.select("doc_id", F.when((F.col("pages") > 0) & (F.col("ocr_pages") == F.col("pages")), "ocr_required").when(F.col("hard"), "degraded").otherwise("ready").alias("status"))


def counts_by(df: DataFrame, key: str, name: str = "counts") -> DataFrame:
    """doc_id and a map from a key's values to how often they occur in the document."""
    counted = df.groupBy("doc_id", key).agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


def report(documents: DataFrame) -> DataFrame:
    """Documents, pages and failures over all, by jurisdiction and by source family, in one pass."""
    sets = documents.groupingSets([[], ["jurisdiction"], ["source_family"]], "jurisdiction", "source_family")
    return sets.agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.count_if(~F.col("ok")).alias("failures"))


def gate(documents: DataFrame, expected_documents: int, expected_pages: int, heading_sections: int, seconds: float) -> DataFrame:
    """One row: whether the corpus passes."""
    done = documents.agg(F.count_if("ok").alias("documents"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("pages"))), F.lit(0)).alias("pages"), F.count_if(~F.col("ok")).alias("failures"))
    good = (F.col("failures") == 0) & (F.col("documents") == expected_documents) & (F.col("pages") == expected_pages) & F.lit(heading_sections == 0) & F.lit(seconds <= MOST_SECONDS)
    return done.withColumn("pass", good)


def most(documents: DataFrame, *measures: str, k: int = 10, id_column: str = "id") -> DataFrame:
    """The k documents with the greatest measures, in order; ties go to the smaller id."""
    return documents.orderBy(*[F.desc(m) for m in measures], id_column).limit(k)


def denominators(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """One row of what a manifest's denominators must be."""
    good = documents.agg(F.count("*").alias("successful_documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("successful_pages"))
    bad = failures.agg(F.count("*").alias("failures"), F.coalesce(F.sum("pages"), F.lit(0)).alias("failure_pages"))
    return good.crossJoin(bad).withColumn("attempts", F.col("successful_documents") + F.col("failures"))  # one row each


def manifest_faults(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Manifest rows that break a rule, with the rule."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    sha = ~F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    one = lambda df, *rules: df.select("id", F.explode(F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda r: r.isNotNull())).alias("rule"))
    rows = one(documents, ("blank_id", blank("id")), ("path", blank("relative_path")), ("sha256", sha), ("pages", F.col("pages") <= 0), ("jurisdiction", blank("jurisdiction")), ("source_family", blank("source_family")))
    rows = rows.unionByName(one(failures, ("blank_id", blank("id")), ("path", blank("relative_path")), ("sha256", sha), ("pages", F.col("pages") <= 0), ("error_code", blank("error_code"))))
    ids = documents.select("id").unionByName(failures.select("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("rule"))
    return rows.unionByName(ids)


def digest(df: DataFrame, *columns: str, name: str = "digest") -> DataFrame:
    """Adds the SHA-256 of the named columns as JSON, in the order named."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*columns)), 256))


def document_id(content: Column) -> Column:
    """doc- and the first 20 digits of the content's SHA-256."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(content, 256), 1, 20))


def violations(pages: DataFrame, lines: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Broken constraints as rows (doc_id, rule, item): identifiers that repeat, lines without a page, spans
    outside their line, nodes without their parent or with a range that ends before it begins."""
    twice = lambda df, key, rule: df.groupBy("doc_id", key).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(rule).alias("rule"), F.col(key).cast("string").alias("item"))
    out = twice(lines, "line_id", "line_id_repeats").unionByName(twice(pages, "page_index", "page_repeats"))
    lost = lines.join(pages.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_anti").select("doc_id", F.lit("line_without_page").alias("rule"), F.col("line_id").cast("string").alias("item"))
    out = out.unionByName(lost)
    if "spans" in lines.columns:
        wrong = F.exists("spans", lambda s: (s["start"] > s["end"]) | (s["end"] > F.length("text")))
        out = out.unionByName(lines.where(wrong).select("doc_id", F.lit("span_outside_line").alias("rule"), F.col("line_id").cast("string").alias("item")))
    if nodes is not None:
        parents = nodes.select("doc_id", F.col("id").alias("parent_id"))
        orphan = nodes.where("parent_id is not null").join(parents, ["doc_id", "parent_id"], "left_anti").select("doc_id", F.lit("node_without_parent").alias("rule"), F.col("id").cast("string").alias("item"))
        backwards = nodes.where("end < start").select("doc_id", F.lit("node_range").alias("rule"), F.col("id").cast("string").alias("item"))
        out = out.unionByName(orphan).unionByName(backwards)
    return out


def retained(cache: DataFrame, limit: int) -> DataFrame:
    """Entries (path, bytes, modified) that stay when the oldest go until the limit is met.

    Sums run over days, and inside a day over its entries, so no task gets more than a day's entries.
    """
    day = F.to_date("modified")
    newest = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    days = cache.groupBy(day.alias("day")).agg(F.sum("bytes").alias("bytes")).select(F.col("day").alias("its_day"), F.coalesce(F.sum("bytes").over(newest), F.lit(0)).alias("newer"))
    inside = Window.partitionBy(day).orderBy(F.desc("modified"), "path").rowsBetween(Window.unboundedPreceding, 0)
    held = cache.withColumn("held", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(days, day.eqNullSafe(F.col("its_day")))
    return held.withColumn("held", F.col("held") + F.col("newer")).where(F.col("held") <= limit).select(*cache.columns, "held")


def latency_summary(batches: DataFrame) -> DataFrame:
    """One row: batches, lines, padding ratio, and latencies at 50 and 95 per cent by the upper rank.

    Latencies are counted by value; values are cut into stretches at approximate quantiles, whose sums (a row for
    each stretch) and a prefix inside each stretch give exact ranks. No task holds the latencies of all batches.
    """
    counted = batches.where("seconds is not null").groupBy("seconds").agg(F.count("*").alias("n"))
    cuts = batches.agg(F.percentile_approx("seconds", [k / STRETCHES for k in range(1, STRETCHES)], F.lit(100 * STRETCHES)).alias("cuts"))
    placed = counted.crossJoin(cuts).select("seconds", "n", F.size(F.filter("cuts", lambda c: c < F.col("seconds"))).alias("stretch"))  # one row of cuts
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    whole = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = placed.groupBy("stretch").agg(F.sum("n").alias("n")).select("stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy("stretch").orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("inside", F.sum("n").over(inside)).join(sums, "stretch")
    at = lambda p: F.min(F.when(F.col("before") + F.col("inside") > F.ceil((F.col("total") - 1) * p / 100), F.col("seconds")))
    told = batches.agg(F.count("*").alias("batches"), F.sum("lines").alias("lines"), (1 - F.sum("used") / F.sum("padded")).alias("padding"))
    return told.crossJoin(ranked.agg(at(50).alias("p50"), at(95).alias("p95")))  # one row each
