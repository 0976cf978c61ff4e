"""Note marks on the page: detached and spliced marks, note regions, rules above notes, drop caps, running heads.

What looks at one line and its neighbours is a window; what consumes lines one after another runs per page,
on the page's lines alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import geometry as G
from lexweave.functions import shapes as S
from lexweave.functions import stats
from lexweave.functions import text as T

# --- Fixed values -----------------------------------------------------------------------------------

BODY_BAND, BODY_SIZES, DEFAULT_SIZE = 0.75, (7.0, 20.0), 10.0
NOTE_CUT, MARK_SIZE, HOST_SIZE = 0.88, 0.75, 0.80
ROW_SHARE, ROW_LEAST, REACH_LEAST = 0.20, 2.0, 6.0
SPLICE_OVERLAP, SPLICE_REACH, SPLICE_SIZE, SPLICE_RISE = 0.5, 12.0, 1.25, 0.25
RULE_WIDTH, RULE_BAND, RULE_NEAR = 0.20, (0.30, 0.98), 3.0
CAP_SIZES, CAP_FACTOR, CAP_BODY, CAP_REACH = (4.0, 24.0), 1.8, 1.4, 3.0
HEAD_BAND, HEAD_SIZE, HEAD_TOLERANCE = 0.12, 0.90, 0.04
BLANK_LABEL = 0

# ----------------------------------------------------------------------------------------------------

_MARK = re.compile(S.PATTERNS["standalone_reference"])
PAGE = ("doc_id", "page_index")
_LINE = ("line_id", "source_index", "text", "x0", "y0", "x1", "y1", "size", "region_type", "excluded", "spans")


def _per_page(lines: DataFrame, pages: DataFrame, columns: tuple[str, ...], work: Callable[[dict, list[dict]], list[tuple]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Runs work(page, lines in source order) on every page; gives a row for each tuple."""
    kinds = {c: lines.schema[c].dataType.simpleString() for c in PAGE}
    extra = [c for c in pages.columns if c not in PAGE]
    listed = lines.select(*PAGE, F.struct("source_index", *[c for c in columns if c != "source_index"]).alias("l")).groupBy(*PAGE).agg(F.array_sort(F.collect_list("l")).alias("ls")).join(pages.select(*PAGE, F.struct(*extra).alias("p")), list(PAGE))
    item = pa.list_(pa.struct([(n, t) for n, _, t in fields]))
    ddl = f"{', '.join(f'{c} {k}' for c, k in kinds.items())}, made array<struct<{','.join(f'{n}:{k}' for n, k, _ in fields)}>>"

    def rows(batches):
        for batch in batches:
            made = [[dict(zip((f[0] for f in fields), t)) for t in work(p, ls)] for p, ls in zip(batch.column("p").to_pylist(), batch.column("ls").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_index"), pa.array(made, item)], names=[*PAGE, "made"])

    return listed.select(*PAGE, "p", "ls").mapInArrow(rows, ddl).select(*PAGE, F.inline("made"))


def _median(values: list[float]) -> float:
    values = sorted(values)
    n = len(values)
    return 0.0 if not n else values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2


def _flat(lines: DataFrame) -> DataFrame:
    """Lines with flat boxes, font sizes and span edges."""
    edges = F.transform("spans", lambda s: F.struct(s["bbox"]["x0"].alias("x0"), s["bbox"]["x1"].alias("x1"), s["start"].alias("start"), s["end"].alias("end")))
    return lines.select(*PAGE, "line_id", "source_index", "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", stats.line_font_size(F.col("spans")).alias("size"), "region_type", F.coalesce("exclude_from_body", F.lit(False)).alias("excluded"), edges.alias("spans"))


def detached_references(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Small marks on lines of their own with the body line and offset that they belong to.

    pages need height and separator_y (null where no rule stands above the notes). Marks are taken in source
    order; a line that has been taken as a mark is no host for later ones.
    """

    def work(page: dict, ls: list[dict]) -> list[tuple]:
        furniture = ("header", "footer")
        body = _median([ln["size"] for ln in ls if ln["region_type"] not in furniture and ln["y0"] < page["height"] * BODY_BAND and BODY_SIZES[0] <= ln["size"] <= BODY_SIZES[1]]) or DEFAULT_SIZE
        cut = page["separator_y"] if page["separator_y"] is not None else page["height"] * NOTE_CUT
        taken, out = {k for k, ln in enumerate(ls) if ln["excluded"]}, []
        for k, mark in enumerate(ls):
            label = mark["text"].strip()
            if not _MARK.match(label) or mark["region_type"] in furniture or not 0 < mark["size"] <= body * MARK_SIZE or mark["y0"] >= cut:
                continue
            centre, options = (mark["x0"] + mark["x1"]) / 2, []
            for j, host in enumerate(ls):
                off = abs(host["y0"] - mark["y0"])
                if j == k or j in taken or host["region_type"] in furniture or host["size"] < body * HOST_SIZE or off > max((host["y1"] - host["y0"]) * ROW_SHARE, ROW_LEAST):
                    continue
                ends = [(abs(centre - x), -at) for s in host["spans"] or [] for x, at in ((s["x0"], s["start"]), (s["x1"], s["end"]))]
                if ends and min(ends)[0] <= max(body, REACH_LEAST):
                    away, at = min(ends)
                    options.append((away, off, abs(host["source_index"] - mark["source_index"]), j, -at))
            if options:
                *_, j, at = min(options)
                taken.add(k)
                out.append((mark["line_id"], ls[j]["line_id"], label, at))
        return out

    fields = [("source_line_id", "string", pa.string()), ("line_id", "string", pa.string()), ("note_id", "string", pa.string()), ("offset", "int", pa.int32())]
    return _per_page(_flat(lines), pages.select(*PAGE, "height", "separator_y"), _LINE, work, fields)


def spliced_markers(lines: DataFrame) -> DataFrame:
    """Digit lines that belong to exactly one of the lines before and after; a host with two claims has neither."""
    order = Window.partitionBy(*PAGE).orderBy("source_index", "line_id")
    orphan = (F.size("spans") > 0) & F.col("text").rlike("^[0-9]{1,4}$")
    size = stats.line_font_size(F.col("spans"))
    fit = lines.where(~F.coalesce(F.col("region_type").isin("header", "footer"), F.lit(False)) & ~F.coalesce("exclude_from_body", F.lit(False)))
    row = F.struct("line_id", "block_index", "bbox", size.alias("size"), orphan.alias("orphan"), F.length("text").alias("chars"))
    seen = fit.select(*PAGE, "line_id", "text", row.alias("me"), F.forall("spans", lambda s: s["superscript"]).alias("raised"), F.lag(row).over(order).alias("before"), F.lead(row).over(order).alias("after"))
    me = F.col("me")

    def takes(host: Column) -> Column:
        overlap = F.least(me["bbox"]["y1"], host["bbox"]["y1"]) - F.greatest(me["bbox"]["y0"], host["bbox"]["y0"])
        near = (me["bbox"]["x0"] >= host["bbox"]["x0"] - SPLICE_REACH) & (me["bbox"]["x0"] <= host["bbox"]["x1"] + SPLICE_REACH)
        small = (me["size"] > 0) & (host["size"] >= SPLICE_SIZE * me["size"]) & (me["bbox"]["y1"] <= host["bbox"]["y1"] - SPLICE_RISE * G.height(host["bbox"]))
        good = ~host["orphan"] & (host["block_index"] == me["block_index"]) & (G.height(me["bbox"]) > 0) & (G.height(host["bbox"]) > 0) & (F.greatest(overlap, F.lit(0.0)) / G.height(me["bbox"]) >= SPLICE_OVERLAP) & near & (F.col("raised") | small)
        return F.coalesce(good, F.lit(False))

    claims = seen.where(me["orphan"]).select(*PAGE, "line_id", "text", takes(F.col("before")).alias("b"), takes(F.col("after")).alias("a"), "before", "after").where("a <> b")
    hosted = claims.select(*PAGE, F.col("line_id").alias("source_line_id"), T.note_label(F.col("text")).alias("note_id"), F.when(F.col("b"), F.col("before.line_id")).otherwise(F.col("after.line_id")).alias("line_id"), F.when(F.col("b"), F.col("before.chars")).otherwise(F.col("after.chars")).alias("offset"))
    return hosted.withColumn("n", F.count("*").over(Window.partitionBy(*PAGE, "line_id"))).where("n = 1").drop("n")


def note_modes(lines: DataFrame) -> DataFrame:
    """The note region mode of each page with notes: endnote, footnote, footnote_continuation or none.

    Endnotes start under a heading and go on while the next page's first number is the expected one. The state
    is a fold over the document's pages, which are a few numbers each.
    """
    number = F.when(F.col("region_type") == "footnote", T.label_prefix(F.col("text"))).try_cast("int")
    given = F.when(F.col("region_type") == "footnote", F.col("note_region_mode"))
    page = lines.groupBy(*PAGE).agg(
        F.count_if(F.col("region_type") == "footnote").alias("notes"),
        F.bool_or(S.is_shape("notes_heading", F.trim("text"))).alias("heading"),
        F.coalesce(F.bool_or(given == "endnote"), F.lit(False)).alias("endnote"),
        F.coalesce(F.bool_or(given == "footnote"), F.lit(False)).alias("footnote"),
        F.transform(F.array_sort(F.collect_list(F.when(number.isNotNull(), F.struct("reading_order", number.alias("n"))))), lambda x: x["n"]).alias("numbers"),
    )
    listed = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "notes", "heading", "endnote", "footnote", "numbers"))).alias("ps"))
    state = "struct<prior:boolean,active:boolean,expected:int,out:array<struct<page_index:int,mode:string>>>"
    start = F.struct(F.lit(False).alias("prior"), F.lit(False).alias("active"), F.lit(None).cast("int").alias("expected"), F.array().cast("array<struct<page_index:int,mode:string>>").alias("out")).cast(state)

    def step(acc: Column, p: Column) -> Column:
        has = p["notes"] > 0
        goes_on = acc["active"] & ((F.size(p["numbers"]) == 0) | F.coalesce(F.get(p["numbers"], F.lit(0)) == acc["expected"], F.lit(False)))
        end = has & (p["heading"] | p["endnote"] | goes_on)
        mode = F.when(end, "endnote").when(has & p["footnote"], "footnote").when(has & acc["prior"], "footnote_continuation").otherwise("")
        last = F.get(p["numbers"], F.size(p["numbers"]) - 1)
        made = F.struct(p["page_index"].cast("int").alias("page_index"), mode.alias("mode"))
        return F.struct(has.alias("prior"), end.alias("active"), F.when(end, F.coalesce(last + 1, acc["expected"])).alias("expected"), F.when(has, F.concat(acc["out"], F.array(made))).otherwise(acc["out"]).alias("out")).cast(state)

    return listed.select("doc_id", F.inline(F.aggregate("ps", start, step, lambda acc: acc["out"])))


def prior_references(labels: DataFrame, marks: DataFrame) -> DataFrame:
    """Labels (doc_id, page_index, line_id, label, y) with a mark of the same value (note_id, y) above them on the page."""
    above = marks.select(*PAGE, F.col("note_id").alias("label"), F.col("y").alias("mark_y")).groupBy(*PAGE, "label").agg(F.min("mark_y").alias("top"))
    return labels.join(above, [*PAGE, "label"]).where("top < y").select(*PAGE, "line_id", "label")


def separators(lines: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The lowest rule of each page that stands above a note: wide, in the lower part, through no text, near a small label.

    rules: doc_id, page_index, x0, x1, y in display space.
    """
    sized = pages.select(*PAGE, "width", "height")
    wide = rules.join(sized, list(PAGE)).where((F.col("x1") - F.col("x0") >= F.col("width") * RULE_WIDTH) & (F.col("y") >= F.col("height") * RULE_BAND[0]) & (F.col("y") <= F.col("height") * RULE_BAND[1])).withColumnsRenamed({"x0": "rx0", "x1": "rx1"})
    boxes = lines.select(*PAGE, "line_id", "text", "bbox", stats.mid_font_size(F.col("spans")).alias("size"))
    through = wide.join(boxes, list(PAGE)).where((F.col("bbox.y0") <= F.col("y")) & (F.col("y") <= F.col("bbox.y1")) & (F.col("bbox.x0") < F.col("rx1")) & (F.col("rx0") < F.col("bbox.x1"))).select(*PAGE, "rx0", "rx1", "y").distinct()
    clear = wide.join(through, [*PAGE, "rx0", "rx1", "y"], "left_anti")
    upper = boxes.join(sized, list(PAGE)).where((F.col("bbox.y0") < F.col("height") * 0.80) & (F.col("size") > 0))
    long = F.length("text") >= 40
    body = upper.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(long, F.col("size"))), F.median("size")).alias("body"))
    lettered = F.col("text").rlike(r"\p{L}")
    begins = F.col("text").rlike(r"^\s*(?:[0-9]{1,3}(?:$|[\s.)\]},:;-])|[*∗†‡])")
    small = boxes.where(begins).join(body, list(PAGE)).where((F.col("body") > 0) & (F.col("size") <= F.col("body") * 0.90))
    other = boxes.where(lettered).select(*PAGE, F.col("bbox").alias("other"))
    beside = small.where(~lettered).join(other, list(PAGE)).where((F.col("other.x0") >= F.col("bbox.x1")) & (F.col("other.y0") < F.col("bbox.y1")) & (F.col("bbox.y0") < F.col("other.y1"))).select(*PAGE, "line_id").distinct()
    labels = small.where(lettered).unionByName(small.where(~lettered).join(beside, [*PAGE, "line_id"], "left_semi")).select(*PAGE, F.col("bbox.y0").alias("label_y"), "body")
    met = clear.join(labels, list(PAGE)).where((F.col("y") <= F.col("label_y") + F.greatest(F.col("height") * 0.004, F.lit(1.0))) & (F.col("label_y") - F.col("y") <= F.col("body") * RULE_NEAR))
    return met.groupBy(*PAGE).agg(F.max("y").alias("separator_y"))


def drop_caps(lines: DataFrame) -> DataFrame:
    """Lines of a page in order with large single letters moved before the line that they begin: line_id and place."""

    def work(page: dict, ls: list[dict]) -> list[tuple]:
        sizes = sorted(ln["size"] for ln in ls if CAP_SIZES[0] <= ln["size"] <= CAP_SIZES[1])
        body = sizes[len(sizes) // 2] if sizes else 0.0
        moves = []
        for k, cap in enumerate(ls):
            letter = cap["text"].strip()
            if body <= 0 or len(letter) != 1 or not letter.isalpha() or cap["size"] < body * CAP_FACTOR:
                continue
            beside = [(ln["y0"], ln["x0"], j) for j, ln in enumerate(ls) if j != k and ln["size"] <= body * CAP_BODY and -body <= ln["x0"] - cap["x1"] <= body * CAP_REACH and ln["y0"] < cap["y1"] and ln["y1"] > cap["y0"]]
            if beside and min(beside)[2] < k:
                moves.append((k, min(beside)[2]))
        order = list(ls)
        for k, target in reversed(moves):
            order.insert(target, order.pop(k))
        return [(ln["line_id"], i) for i, ln in enumerate(order)]

    pages = lines.select(*PAGE).distinct().withColumn("n", F.lit(0))
    return _per_page(_flat(lines), pages, _LINE, work, [("line_id", "string", pa.string()), ("place", "int", pa.int32())])


def running_heads(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines that join a page's headers: in the top band, of the same small type, flush and next to one, until none joins."""

    def work(page: dict, ls: list[dict]) -> list[tuple]:
        band, tolerance = page["height"] * HEAD_BAND, page["width"] * HEAD_TOLERANCE
        sizes = sorted(ln["size"] for ln in ls if page["height"] * 0.10 <= ln["y0"] <= page["height"] * 0.75 and CAP_SIZES[0] <= ln["size"] <= CAP_SIZES[1])
        body = (sizes[min(len(sizes) * 3 // 4, len(sizes) - 1)] if sizes else 0.0) or DEFAULT_SIZE
        heads = {k for k, ln in enumerate(ls) if ln["region_type"] == "header" and ln["y1"] < band}
        old = set(heads)

        def joins(k: int) -> bool:
            ln = ls[k]
            return any(
                abs(h["size"] - ln["size"]) <= 0.5
                and (abs(h["x0"] - ln["x0"]) <= tolerance or abs((h["x0"] + h["x1"]) - (ln["x0"] + ln["x1"])) / 2 <= tolerance)
                and max(ln["y0"] - h["y1"], h["y0"] - ln["y1"]) <= 0.5 * max(h["y1"] - h["y0"], ln["y1"] - ln["y0"])
                for h in (ls[i] for i in heads)
            )

        while new := {k for k, ln in enumerate(ls) if k not in heads and ln["region_type"] != "header" and ln["y1"] < band and 0 < ln["size"] < body * HEAD_SIZE and joins(k)}:
            heads |= new
        return [(ls[k]["line_id"],) for k in sorted(heads - old)]

    return _per_page(_flat(lines), pages.select(*PAGE, "width", "height"), _LINE, work, [("line_id", "string", pa.string())])


def note_order(lines: DataFrame, models: DataFrame) -> DataFrame:
    """Order of note lines: by column where the page has two, then by height; a label stands with the body beside it."""
    from lexweave.operators.regions import nearest_label

    alone = S.is_shape("note_label_alone", F.col("text"))
    paired = nearest_label(lines.where(alone), lines).join(lines.select(*PAGE, F.col("line_id").alias("body_id"), F.col("bbox.y0").alias("body_y")), [*PAGE, "body_id"]).select(*PAGE, "line_id", "body_y")
    split = models.where("kind = 'two_column'").select(*PAGE, "split_x")
    met = lines.join(paired, [*PAGE, "line_id"], "left").join(split, list(PAGE), "left")
    right = F.coalesce(G.center_x(F.col("bbox")) >= F.col("split_x"), F.lit(False)).cast("int")
    order = Window.partitionBy(*PAGE).orderBy(right, F.coalesce("body_y", "bbox.y0"), "bbox.x0", "line_id")
    return met.select(*PAGE, "line_id", F.row_number().over(order).alias("rank"))


def word_boxes(lines: DataFrame) -> DataFrame:
    """Words of lines recognised without word boxes, spaced evenly over the line's box."""
    parts = F.split("text", " ")
    cut = lines.select(*PAGE, "line_id", "bbox", F.length("text").alias("chars"), F.posexplode(parts).alias("pos", "word"))
    before = Window.partitionBy(*PAGE, "line_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    advance = G.width(F.col("bbox")) / F.greatest("chars", F.lit(1))
    placed = cut.withColumns({"start": start, "advance": advance})
    box = F.struct((F.col("bbox.x0") + F.col("start") * F.col("advance")).alias("x0"), F.col("bbox.y0").alias("y0"), (F.col("bbox.x0") + (F.col("start") + F.length("word")) * F.col("advance")).alias("x1"), F.col("bbox.y1").alias("y1"))
    return placed.where("word <> ''").select(*PAGE, "line_id", "pos", "word", box.alias("bbox"))


def known_regions(lines: DataFrame) -> DataFrame:
    """Documents whose every line with text has a known region and an id of its own."""
    used = lines.where(~F.coalesce("exclude_from_body", F.lit(False)) & (F.trim("text") != ""))
    known = ~F.lower(F.trim(F.coalesce("region_type", F.lit("")))).isin("", "unknown", "unknown_region")
    told = used.groupBy("doc_id").agg(F.bool_and(known & (F.coalesce("line_id", F.lit("")) != "")).alias("known"), (F.count("*") == F.countDistinct("line_id")).alias("single"))
    return told.where("known and single").select("doc_id")


def ctc_labels(logits, length: int) -> list[tuple[int, float]]:
    """Greedy reading of a (classes, steps) matrix: labels without repeats and blanks, with their best probability."""
    import numpy as np

    part = np.asarray(logits, np.float32)[:, :length]
    labels, top = part.argmax(0), part.max(0)
    sure = 1 / np.maximum(np.exp(part - top).sum(0), np.finfo(np.float32).tiny)
    out: list[tuple[int, float]] = []
    before = -1
    for label, p in zip(labels.tolist(), sure.tolist()):
        if label != BLANK_LABEL:
            if label != before:
                out.append((label, p))
            else:
                out[-1] = (label, max(out[-1][1], p))
        before = label
    return out


def otsu_threshold(gray) -> int:
    """The level that parts dark from light with the greatest variance between them; 128 for an empty image."""
    import numpy as np

    counts = np.bincount(np.asarray(gray, np.uint8).ravel(), minlength=256).astype(np.float64)
    total = counts.sum()
    if not total:
        return 128
    below, moment = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    spread = below * (total - below)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(spread > 0, (moment[-1] * below - moment * total) ** 2 / spread, 0.0)
    return int(between.argmax()) if between.max() > 0 else 0
