"""Enumerated headings as an outline: a stack of counters read in order."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------

MOST_DEPTH = 4
MOST_COUNTER = 200
SUSPECT_VALUE = 15
OUTLINE = r"^\s*(\d{1,2}(?:\.\d{1,2}){0,3})([.)]?)(\s+)(\S.*)$"
OUTLINE_LINES, OUTLINE_NESTED, OUTLINE_X = 4, 2, (6.0, 800.0, 0.015)
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

# ----------------------------------------------------------------------------------------------------


def roman_number(text: str) -> int | None:
    total = prior = 0
    for c in reversed(text.upper()):
        if c not in ROMAN:
            return None
        total += -ROMAN[c] if ROMAN[c] < prior else ROMAN[c]
        prior = max(prior, ROMAN[c])
    return total if 0 < total <= MOST_COUNTER else None


def readings(value: str, punct: str) -> list[tuple[str, int]]:
    """The (family, number) readings of an enumerator: a letter may be a Roman number too, which comes first."""
    counted = lambda family, n: [(f"{family}_{punct}", n)] if n is not None and 1 <= n <= MOST_COUNTER else []
    if re.fullmatch(r"\d{1,2}(?:\.\d{1,2}){1,3}", value):
        return counted("legal_numeric", int(value.rsplit(".", 1)[1]))
    if re.fullmatch("[0-9]+", value):
        return counted("numeric", int(value))
    if re.fullmatch("[IVXLCDM]{2,7}", value):
        return counted("roman", roman_number(value))
    if len(value) == 1 and value.isalpha():
        roman = counted("roman", ROMAN.get(value)) if value in ROMAN else []
        return roman + [(f"{'upper' if value.isupper() else 'lower'}_alpha_{punct}", ord(value.upper()) - 64)]
    return []


def place(stack: list[tuple[str, int]], choices: list[tuple[str, int]]) -> tuple[str, int | None, str, int | None]:
    """Moves the stack by the first rule that a reading fits; gives family, value, action and level.

    Rules in order: the next number of an open family; a new family at 1; an open family at 1 again or the
    shortest jump forward; a new family at another number. A family's inner levels close when it moves.
    """
    held = {family: i for i, (family, _) in enumerate(stack)}

    def move(family: str, value: int, action: str) -> tuple[str, int, str, int]:
        at = held.get(family, len(stack))
        stack[at:] = [(family, value)]
        return family, value, action, at + 1

    for family, value in choices:
        if family in held and stack[held[family]][1] + 1 == value:
            return move(family, value, "increment")
    room = len(stack) < MOST_DEPTH
    for family, value in choices:
        if value == 1 and family not in held and room:
            return move(family, value, "open_level")
    jumps = []
    for family, value in choices:
        if family in held:
            if value == 1 and not jumps:
                return move(family, value, "illegal_restart")
            gap = value - stack[held[family]][1]
            if gap > 1:
                jumps.append((gap, len(jumps), family, value))
    if jumps:
        return move(*min(jumps)[2:], "jump_forward")
    for family, value in choices:
        if family not in held and room:
            return move(family, value, "open_midcounter")
    family, value = choices[0] if choices else ("unknown", None)
    return family, value, "violation", None


def read_ladder(candidates: list[tuple[str, str]]) -> tuple[list[tuple], str]:
    """Assignments of enumerators (value, punctuation) in order, and the outline's status."""
    stack: list[tuple[str, int]] = []
    out = [place(stack, readings(*c)) for c in candidates]
    bad = sum(a[2] in ("violation", "illegal_restart") for a in out)
    if not out:
        return out, "no_enumerators"
    return out, "parsed_clean" if not bad else "parsed_with_violations" if bad <= max(1, len(out) // 5) else "unparseable"


def heading_ladder(candidates: DataFrame) -> DataFrame:
    """doc_id, seq, family, value, action, level, status for candidates (doc_id, seq, value, punct) of each document."""
    kind = candidates.schema["doc_id"].dataType.simpleString()
    listed = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "value", "punct"))).alias("items"))
    item = pa.list_(pa.struct([("seq", pa.int64()), ("family", pa.string()), ("value", pa.int32()), ("action", pa.string()), ("level", pa.int32())]))

    def rows(batches):
        for batch in batches:
            made, status = [], []
            for items in batch.column("items").to_pylist():
                out, state = read_ladder([(i["value"], i["punct"]) for i in items])
                made.append([{"seq": i["seq"], "family": a[0], "value": a[1], "action": a[2], "level": a[3]} for i, a in zip(items, out)])
                status.append(state)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, item), pa.array(status)], names=["doc_id", "made", "status"])

    told = listed.mapInArrow(rows, f"doc_id {kind}, made array<struct<seq:bigint,family:string,value:int,action:string,level:int>>, status string")
    return told.select("doc_id", F.inline("made"), "status")


def suspect_families(ladder: DataFrame) -> DataFrame:
    """Numeric families that reach high numbers at one level: more likely notes than headings."""
    used = ladder.where("level is not null").groupBy("doc_id", "family").agg(F.count("*").alias("n"), F.max("value").alias("max_value"), F.countDistinct("level").alias("levels"))
    numeric = F.col("family").startswith("numeric_") | F.col("family").startswith("legal_numeric_")
    return used.withColumn("footnote_suspect", numeric & (F.col("max_value") >= SUSPECT_VALUE) & (F.col("levels") == 1))


def numeric_outlines(lines: DataFrame) -> DataFrame:
    """Lines of pages whose numbered lines form one outline: doc_id, page_index, line_id, start, end, depth.

    lines: doc_id, page_index, reading_order, line_id, text, x0, page_width. Numbers such as 2.1 rise down the page,
    every nested one has its parent before it, the ladder reads without a violation, and the lines of one depth
    start at one place across. A page needs four such lines, two of them nested.
    """
    from lexweave.operators.candidates import title_plausible

    page = ["doc_id", "page_index"]
    parts = F.transform(F.split(F.regexp_extract("text", OUTLINE, 1), r"\."), lambda v: v.try_cast("int"))
    begin = F.length(F.regexp_extract("text", r"^(\s*)", 1))
    size = F.length(F.regexp_extract("text", OUTLINE, 1)) + F.length(F.regexp_extract("text", OUTLINE, 2))
    found = lines.where(F.col("text").rlike(OUTLINE)).select(*page, "reading_order", "line_id", "x0", "page_width", parts.alias("parts"), F.regexp_extract("text", OUTLINE, 1).alias("value"), F.regexp_extract("text", OUTLINE, 2).alias("punct"), begin.alias("start"), (begin + size).alias("end"), F.regexp_extract("text", OUTLINE, 4).alias("title"))
    rows = found.where(title_plausible(F.col("title")) & ((F.size("parts") > 1) | (F.col("punct") != ""))).withColumn("depth", F.size("parts"))
    order = Window.partitionBy(*page).orderBy("reading_order", "line_id")
    rises = F.coalesce(F.col("parts") > F.lag("parts").over(order), F.lit(True))
    spread = F.max("x0").over(Window.partitionBy(*page, "depth")) - F.min("x0").over(Window.partitionBy(*page, "depth"))
    seen = rows.withColumns({"rises": rises, "spread": spread, "width": F.first(F.when(F.col("page_width") != 0, F.col("page_width")), True).over(Window.partitionBy(*page))})
    listed = seen.groupBy(*page).agg(F.count("*").alias("n"), F.count_if(F.col("depth") > 1).alias("nested"), F.bool_and("rises").alias("rises"), F.max("spread").alias("spread"), F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("reading_order", "line_id", "parts", "value", F.when(F.col("punct") == "", ".").otherwise(F.col("punct")).alias("punct")))).alias("items"))
    # Parents are smaller than their children, so in rising lists they stand before them.
    parented = F.forall("items", lambda i: (F.size(i["parts"]) == 1) | F.exists("items", lambda p: p["parts"] == F.slice(i["parts"], 1, F.size(i["parts"]) - 1)))
    wide = F.greatest(F.lit(OUTLINE_X[0]), F.coalesce("width", F.lit(OUTLINE_X[1])) * OUTLINE_X[2])
    fair = listed.where((F.col("n") >= OUTLINE_LINES) & (F.col("nested") >= OUTLINE_NESTED) & F.col("rises") & (F.col("spread") <= wide)).where(parented)
    kinds = {c: lines.schema[c].dataType.simpleString() for c in page}

    def clean(batches):
        for batch in batches:
            keep = [read_ladder([(i["value"], i["punct"]) for i in items])[1] == "parsed_clean" for items in batch.column("items").to_pylist()]
            yield batch.select(page).filter(pa.array(keep, pa.bool_()))

    good = fair.select(*page, F.transform("items", lambda i: F.struct(i["value"].alias("value"), i["punct"].alias("punct"))).alias("items")).mapInArrow(clean, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    return rows.join(good, page).select(*page, "line_id", "start", "end", "depth")
