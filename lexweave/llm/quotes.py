"""Quotation linking: reply-ordered conversations without quotes, with DataFrame operations alone.

A line that begins with marks ">" (and blanks between them) is quoted; its level is the number of marks. A
passage is a paragraph of lines of one level, or one such line; it is normalised (white space runs become one
space, lower case) and hashed. A message's passages of level 0 are its own. A quoted passage is linked to the
latest earlier message of the conversation that has it as its own. A message's parent is, among the links of
its lowest linked level, the message with the most linked characters (ties: the latest). Its root is the end
of the chain of parents. A conversation's messages are put in order of (root, turn): a reply follows what it
replies to, and messages of one thread stand together.

The latest earlier owner is found as of the turn, not by pairing all owners with all quotes: turns are cut
into stretches, a window looks inside a stretch and a window over the stretches' last owners looks before it.
The order is a prefix over stretches of roots, roots, stretches of turns and rows. So no window holds more
than a small share of a conversation that has a third of all rows.

Defined results: a null text is an empty one; a text of quotes alone becomes empty; a text without quotes is
left as it is; rows that repeat a (conv_id, turn) share their links and have places of their own; a null
conv_id or turn takes no part in links and has a null position; a quote whose source is not found, or stands
in the same or a later turn, is removed and counted but not linked; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MARKS = r"^[ \t]*(>[ \t]*)+"
#: Turns in a stretch.
STRETCH = 1000


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " ")))


def parse(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages with their lines as (level, content) and the levels that occur."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("content")))
    return df.select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        lines.alias("lines"),
    )


def passages(parsed: DataFrame) -> DataFrame:
    """conv, turn, level, passage: the distinct normalised paragraphs and lines of every level.

    Lines are joined with their level in front and an empty line wherever the level changes, so that one split
    gives the paragraphs of all levels, however many a message has.
    """

    def marked(x: Column, i: Column) -> Column:
        text = F.when(x["content"].rlike(r"^[ \t\r\f\x0b]*$"), "").otherwise(F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"), x["content"]))
        return F.when((i > 0) & (F.get("lines", i - 1)["level"] != x["level"]), F.concat(F.lit("\n"), text)).otherwise(text)

    pieces = F.split(F.array_join(F.transform("lines", marked), "\n"), r"\n[ \t\r\f\x0b]*\n")
    level = lambda p: F.regexp_extract(p, r"\x01(\d+)\x02", 1)
    paragraphs = F.transform(F.filter(pieces, lambda p: level(p) != ""), lambda p: F.struct(level(p).cast("int").alias("level"), _normal(F.regexp_replace(p, r"(?m)^\x01\d+\x02", "")).alias("passage")))
    singles = F.transform("lines", lambda x: F.struct(x["level"].cast("int").alias("level"), _normal(x["content"]).alias("passage")))
    units = F.array_distinct(F.filter(F.concat(paragraphs, singles), lambda u: u["passage"] != ""))
    return parsed.select("conv", "turn", F.inline(units))


def links(parsed: DataFrame) -> DataFrame:
    """conv, turn, level, source_turn, n_chars of every quoted passage that has a source."""
    parsed = parsed.where("conv is not null and turn is not null")
    units = passages(parsed).select("conv", "turn", "level", F.xxhash64("passage").alias("hash"), F.length("passage").alias("chars"))
    quoted = units.where("level > 0").distinct()
    owned = units.where("level = 0").join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    stretch = F.floor(F.col("turn") / STRETCH).alias("stretch")
    events = quoted.select("conv", "hash", "turn", stretch, "level", "chars", F.lit(None).cast("bigint").alias("owner")).unionByName(
        owned.select("conv", "hash", "turn", stretch, F.lit(0).alias("level"), "chars", F.col("turn").alias("owner"))
    )
    events = stored(events, "quote-events")
    earlier = Window.partitionBy("conv", "hash", "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = events.select("*", F.max("owner").over(earlier).alias("near")).where("level > 0")
    before = Window.partitionBy("conv", "hash").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = events.groupBy("conv", "hash", "stretch").agg(F.max("owner").alias("last")).select("conv", "hash", "stretch", F.max("last").over(before).alias("far"))
    found = inside.join(ends, ["conv", "hash", "stretch"], "left")
    return found.select("conv", "turn", "level", F.coalesce("near", "far").alias("source_turn"), "chars").where("source_turn is not null")


def _roots(parents: DataFrame) -> DataFrame:
    """conv, turn, parent, root of the linked messages, by jumping twice as far each round."""
    now = stored(parents.select("conv", "turn", "parent", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"))
        joined = now.join(up, ["conv", "root"], "left")
        if joined.where("above is not null").isEmpty():
            return now
        now = stored(joined.select("conv", "turn", "parent", F.coalesce("above", "root").alias("root")), "roots")


def reply_order(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: its place in reply order, its parent and root, and its text without quotes.

    Columns: conv_id, turn, role, text, position (from 0), parent_turn, root_turn, quote_depth, n_quoted
    (quoted lines), n_linked (linked passages).
    """
    parsed = parse(df, conv, turn, role, text)
    found = stored(links(parsed), "links")
    linked = found.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"), F.min("level").alias("level"))
    weight = found.join(linked.select("conv", "turn", "level"), ["conv", "turn", "level"]).groupBy("conv", "turn", "source_turn").agg(F.sum("chars").alias("chars"))
    parents = weight.groupBy("conv", "turn").agg(F.max(F.struct("chars", "source_turn")).alias("best")).select("conv", "turn", F.col("best.source_turn").alias("parent"))
    roots = _roots(parents).join(linked.select("conv", "turn", "n_linked"), ["conv", "turn"])
    own = F.filter("lines", lambda x: x["level"] == 0)
    quoted = F.filter("lines", lambda x: x["level"] > 0)
    bare = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"^[\n\r]+|[\n\r]+$", "")
    messages = parsed.select(
        "conv",
        "turn",
        "role",
        F.when(F.size(quoted) > 0, bare).otherwise(F.col("text")).alias("text"),
        F.array_max(F.transform("lines", lambda x: x["level"])).alias("quote_depth"),
        F.size(quoted).cast("bigint").alias("n_quoted"),
    )
    placed = messages.join(roots, ["conv", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    placed = stored(placed.withColumns({"g": F.floor(F.col("root") / STRETCH), "h": F.floor(F.col("turn") / STRETCH)}), "messages")
    whole = placed.where("conv is not null and turn is not null")
    runs = whole.groupBy("conv", "g", "root", "h").agg(F.count("*").alias("n"))
    of_root = runs.groupBy("conv", "g", "root").agg(F.sum("n").alias("n"))
    of_stretch = of_root.groupBy("conv", "g").agg(F.sum("n").alias("n"))

    def before(keys: list[str], by: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    starts = (
        runs.select("conv", "g", "root", "h", before(["conv", "g", "root"], "h").alias("c"))
        .join(of_root.select("conv", "g", "root", before(["conv", "g"], "root").alias("b")), ["conv", "g", "root"])
        .join(of_stretch.select("conv", "g", before(["conv"], "g").alias("a")), ["conv", "g"])
        .select("conv", "root", "h", (F.col("a") + F.col("b") + F.col("c")).alias("start"))
    )
    within = Window.partitionBy("conv", "root", "h").orderBy("turn", "role", "text")
    ordered = whole.join(starts, ["conv", "root", "h"]).withColumn("position", F.col("start") + F.row_number().over(within) - 1)
    rest = placed.where("conv is null or turn is null").withColumn("position", F.lit(None).cast("bigint"))
    columns = [F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "position", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), F.col("quote_depth").cast("int").alias("quote_depth"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked")]
    return ordered.select(*columns).unionByName(rest.select(*columns))
