"""Sources and sinks: PDF bytes, JSON (plain, gzip, lines), manifests, caches and OCR tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------

MOST_BYTES = 100 * 1024 * 1024
SIGNATURE, SIGNATURE_BYTES = "%PDF-", 1024
MOST_PAGES, MOST_LINES, MOST_TEXT_BYTES = 1000, 10_000, 16 * 1024 * 1024
PAGE_SIZE_TOLERANCE = 0.5
MANIFEST_PATH = r"^[^/\x00].{0,1023}$"
TSV_FIELDS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
WORD_LEVEL = 5
ROMAN_PARTS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))

OCR_SCHEMA = (
    "source_sha256 string, pages array<struct<page_index:int,width:double,height:double,lines:array<struct<text:string,bbox:array<double>,"
    "confidence:double,words:array<struct<text:string,bbox:array<double>,start:int,end:int>>>>>>"
)

# ----------------------------------------------------------------------------------------------------


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with path, length and content; the size limits are on metadata, before any content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).where(F.col("length").between(1, MOST_BYTES))


def asset_digests(files: DataFrame) -> DataFrame:
    """The SHA-256 of every file of read_binary, each path once however often it is listed."""
    return files.select("path", "length", "content").dropDuplicates(["path"]).select("path", "length", F.sha2("content", 256).alias("sha256"))


def is_pdf(content: Column) -> Column:
    """The signature stands in the first kilobyte."""
    return F.instr(F.decode(F.substring(content, 1, SIGNATURE_BYTES), "ISO-8859-1"), SIGNATURE) > 0


def accepted(files: DataFrame) -> DataFrame:
    """PDF files with their digests and document ids."""
    return files.where(is_pdf(F.col("content"))).select("path", "length", F.sha2("content", 256).alias("source_sha256"), F.concat(F.lit("doc-"), F.substring(F.sha2("content", 256), 1, 20)).alias("doc_id"), "content")


def page_selection(pages: Column, page_count: Column) -> Column:
    """Sorted distinct page indexes of a list of page numbers; null where the list or a number is out of range."""
    out = F.array_sort(F.array_distinct(F.transform(pages, lambda p: p - 1)))
    bad = ~F.size(pages).between(1, MOST_PAGES) | F.exists(pages, lambda p: p.isNull() | (p < 1) | (p > page_count))
    return F.when(~F.coalesce(bad, F.lit(True)), out)


def manifest_path_ok(path: Column) -> Column:
    """A relative path to a PDF that does not leave its root."""
    parts = F.split(path, "[/\\\\]")
    return F.coalesce(path.rlike(MANIFEST_PATH) & F.lower(path).endswith(".pdf") & ~F.exists(parts, lambda p: p.isin("..", "")) & ~path.rlike("^[A-Za-z]:"), F.lit(False))


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (path, sha256, pages) with what became of them: ok, bad_path, missing or changed."""
    found = files.select(F.col("relative_path").alias("path"), F.sha2("content", 256).alias("found"))
    met = manifest.join(found, "path", "left")
    state = F.when(~manifest_path_ok(F.col("path")), "bad_path").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").otherwise("ok")
    return met.select("path", "sha256", "pages", state.alias("state"))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents or JSON lines; gzip files by their extension."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def write_json(df: DataFrame, path: str, compressed: bool = True) -> None:
    """JSON lines, with gzip by default; the writer's commit puts whole files in place."""
    df.write.option("compression", "gzip" if compressed else "none").json(path)


def pretty_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def spaced_json(value: Column) -> Column:
    """JSON with a space after commas and colons outside strings, as some consumers expect."""
    import json

    @F.pandas_udf("string")
    def respace(texts):
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False))

    return respace(F.to_json(value))


def box_of(array: Column) -> Column:
    return F.struct(*(F.get(array, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def supplied_ocr_faults(ocr: DataFrame, source_sha256: Column) -> DataFrame:
    """Supplied OCR documents (doc_id, OCR_SCHEMA) with the first rule that they break; null where none is."""
    def inside(b: Column, p: Column) -> Column:
        ends = [F.get(b, F.lit(i)) for i in range(4)]
        return F.coalesce((ends[0] >= 0) & (ends[1] >= 0) & (ends[2] > ends[0]) & (ends[3] > ends[1]) & (ends[2] <= p["width"]) & (ends[3] <= p["height"]), F.lit(False))

    def line_ok(ln: Column, p: Column) -> Column:
        words = F.forall(F.coalesce(ln["words"], F.array()), lambda w: inside(w["bbox"], p) & (w["start"] <= w["end"]) & (w["end"] <= F.length(ln["text"])))
        return inside(ln["bbox"], p) & ln["confidence"].between(0, 1) & words

    page_ok = lambda p: (p["width"] > 0) & (p["height"] > 0) & (F.size(p["lines"]) <= MOST_LINES)
    text = F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, p: a + F.aggregate(p["lines"], F.lit(0).cast("bigint"), lambda b, ln: b + F.octet_length(ln["text"])))
    fault = (
        F.when(F.col("source_sha256") != source_sha256, "source")
        .when(F.size("pages") > MOST_PAGES, "pages")
        .when(F.size(F.array_distinct(F.transform("pages", lambda p: p["page_index"]))) != F.size("pages"), "repeated_page")
        .when(~F.forall("pages", page_ok), "page")
        .when(text > MOST_TEXT_BYTES, "text")
        .when(~F.forall("pages", lambda p: F.forall(p["lines"], lambda ln: line_ok(ln, p))), "line")
    )
    return ocr.withColumn("fault", fault)


def supplied_lines(ocr: DataFrame, requests: DataFrame) -> DataFrame:
    """OCR lines for requested pages (doc_id, page_index, width, height); a page whose size differs has fault size, an absent one missing."""
    pages = ocr.select("doc_id", F.inline("pages")).select("doc_id", "page_index", F.col("width").alias("w"), F.col("height").alias("h"), "lines")
    met = requests.join(pages, ["doc_id", "page_index"], "left")
    off = (F.abs(F.col("w") - F.col("width")) > PAGE_SIZE_TOLERANCE) | (F.abs(F.col("h") - F.col("height")) > PAGE_SIZE_TOLERANCE)
    fault = F.when(F.col("lines").isNull(), "missing").when(off, "size")
    return met.select("doc_id", "page_index", fault.alias("fault"), F.when(fault.isNull(), F.col("lines")).alias("lines"))


def weak_pages(pages: DataFrame, recognised: DataFrame, least_quality: float) -> DataFrame:
    """Pages below a quality with what the recogniser gave: the pages to replace and those that stay unresolved."""
    weak = pages.where(F.col("text_quality") < least_quality)
    met = weak.join(recognised.select("doc_id", "page_index", F.lit(True).alias("seen")).distinct(), ["doc_id", "page_index"], "left")
    return met.select("doc_id", "page_index", F.when(F.col("seen"), "recognised").otherwise("OCR_REQUIRED").alias("state"))


def ocr_words(tsv: DataFrame) -> DataFrame:
    """Word rows of OCR tables (text columns, one for each field) as numbers; rows that cannot be read go."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    others = [c for c in tsv.columns if c not in TSV_FIELDS]
    rows = tsv.where((F.col("level") == str(WORD_LEVEL)) & (F.trim("text") != "")).select(
        *others, *(F.coalesce(c, F.lit("0")).alias(c) for c in ("page_num", "block_num", "par_num", "line_num")),
        F.coalesce(F.expr("try_cast(word_num as bigint)"), F.lit(0)).alias("word_num"), *(number(c).alias(c) for c in ("left", "top", "width", "height")),
        F.coalesce(number("conf"), F.lit(0.0)).alias("conf"), F.trim("text").alias("text"),
    )
    return rows.where("left is not null and top is not null and width > 0 and height > 0")


def ocr_lines(tsv: DataFrame, keys: tuple[str, ...] = (), x_scale: float = 1.0, y_scale: float = 1.0, page_width: float = float("inf"), page_height: float = float("inf")) -> DataFrame:
    """Lines of OCR tables: words in order with their boxes scaled and cut to the page, mean confidence of the known words."""
    words = ocr_words(tsv)
    x0, y0 = F.greatest(F.col("left") * x_scale, F.lit(0.0)), F.greatest(F.col("top") * y_scale, F.lit(0.0))
    x1, y1 = F.least((F.col("left") + F.col("width")) * x_scale, F.lit(page_width)), F.least((F.col("top") + F.col("height")) * y_scale, F.lit(page_height))
    boxed = words.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1})
    listed = boxed.groupBy(*keys, "page_num", "block_num", "par_num", "line_num").agg(
        F.array_sort(F.collect_list(F.struct("word_num", "x0", "text"))).alias("ws"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100, F.lit(0.0)))).alias("confidence"),
    )
    return listed.select(*keys, "page_num", "block_num", "par_num", "line_num", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"), F.struct("x0", "y0", "x1", "y1").alias("bbox"), "confidence", F.size("ws").alias("n_words"))


def roman_numeral(number: Column) -> Column:
    """A positive number in upper-case Roman numerals."""
    start = F.struct(number.cast("bigint").alias("rest"), F.lit("").alias("text"))
    parts = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN_PARTS])
    step = lambda a, p: F.struct((a["rest"] % p["v"]).alias("rest"), F.concat(a["text"], F.repeat(p["s"], F.floor(a["rest"] / p["v"]).cast("int"))).alias("text"))
    return F.aggregate(parts, start, step, lambda a: a["text"])


def page_labels(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Labels of pages (doc_id, page_index) by the last rule (doc_id, first, style, prefix, start) at or before each.

    One number out of range or one unknown style voids all labels of the document.
    """
    events = pages.select("doc_id", "page_index", F.lit(None).cast("struct<first:int,style:string,prefix:string,start:int>").alias("rule"), F.lit(1).alias("turn"))
    marks = rules.select("doc_id", F.col("first").cast("int").alias("page_index"), F.struct(F.col("first").cast("int").alias("first"), "style", "prefix", F.col("start").cast("int").alias("start")).alias("rule"), F.lit(0).alias("turn"))
    order = Window.partitionBy("doc_id").orderBy("page_index", "turn").rowsBetween(Window.unboundedPreceding, 0)
    met = events.unionByName(marks).withColumn("rule", F.last("rule", True).over(order)).where("turn = 1")
    number = F.coalesce("rule.start", F.lit(1)) + F.col("page_index") - F.col("rule.first")
    style = F.coalesce("rule.style", F.lit(""))
    letters = F.repeat(F.char(F.lit(65) + (number - 1) % 26), (F.floor((number - 1) / 26) + 1).cast("int"))
    suffix = F.when(style == "D", number.cast("string")).when(style == "R", roman_numeral(number)).when(style == "r", F.lower(roman_numeral(number))).when(style == "A", letters).when(style == "a", F.lower(letters)).otherwise(F.lit(""))
    bad = F.col("rule").isNotNull() & (~number.between(1, 100_000) | ~style.isin("D", "R", "r", "A", "a", ""))
    told = met.select("doc_id", "page_index", F.when(F.col("rule").isNotNull() & ~bad, F.concat(F.coalesce("rule.prefix", F.lit("")), suffix)).alias("label"), F.max(bad).over(Window.partitionBy("doc_id")).alias("void"))
    return told.select("doc_id", "page_index", F.when(~F.col("void") & (F.col("label") != ""), F.col("label")).alias("label"))


def cache_key(source_sha256: Column, engine: str, provider: Column, pages: Column) -> Column:
    """Key of a cached result: the digest of source, engine, provider and pages."""
    return F.sha2(F.to_json(F.struct(source_sha256.alias("source"), F.lit(engine).alias("engine"), provider.alias("provider"), pages.alias("pages"))), 256)


def to_parse(sources: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Sources without a cached result."""
    return sources.join(cache.select(key).distinct(), key, "left_anti")
