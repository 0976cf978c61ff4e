"""Mixing sources to target weights by systematic sampling, with DataFrame operations alone.

A document's expected copies are target / size of its source. Documents of a source are put in order of
(size, salt, id), their expected copies are summed up, one offset is added for the source, and a document
is taken once for every integer that its stretch of the sum crosses. As documents are in order of size, the
taken words come close to the target, and the number of copies differs from the expected one by less than 1.

Targets: sources in code point order (null last) have the weights in turn and share the size of everything;
a target stops at cap times its source's size, and the excess is shared out again by weight. That fixed
point is min(cap * size, level * weight) with one level for all, found by a prefix over the sources in order
of cap * size / weight.

The order is a prefix over (source, size) cells, then over salts in a cell, then over rows in a (cell, salt);
the salt is a hash of the id over about sqrt(rows) values, so that no group gathers a hot source's rows.

Defined results: a null text has size 0; a source of size 0 has the target 0 and none of its documents is
taken; null is a source of its own; repeated rows are separate documents; an empty table gives no row;
input columns beside id, text and source are not read, so names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
CAP = 3


def hex_number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def source_targets(sources: DataFrame, keys: list[str], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds weight and target to a table of sources with their sizes (source_size)."""
    rank = F.row_number().over(Window.orderBy(*keys)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("bigint")
    full = cap * F.col("source_size")
    weighed = sources.select("*", weight.alias("weight"))
    ratio = full / F.col("weight")
    order = Window.orderBy(ratio, *keys)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(ratio, *keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(full).over(before), F.lit(0))).alias("left_size"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    ).select("*", (F.col("left_size") / F.col("left_weight")).alias("level"))
    # The first source, in order of full / weight, that the level reaches does not fill up; its level is that of all.
    reached = levels.select("*", F.min(F.when(F.col("level") * F.col("weight") <= full, F.struct(ratio.alias("r"), *keys, "level"))).over(whole).alias("first"))
    return reached.select(*sources.columns, "weight", F.least(full.cast("double"), F.col("first.level") * F.col("weight")).alias("target"))


def systematic_mix(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 7, tie: str | None = None) -> DataFrame:
    """Copies of every document in the mix: id, size, source_size, target, copies, taken (copies * size).

    tie: a bigint column that orders rows of one id and is carried along.
    """
    ties = [F.col(tie).alias("tie")] if tie else []
    narrow = df.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.col(source).isNull().alias("none"),
        F.coalesce(F.col(source), F.lit("")).alias("name"),
        *ties,
    )
    narrow = stored(narrow, "mix")
    salts = math.isqrt(narrow.count()) + 1
    rows = narrow.withColumn("salt", hex_number(F.coalesce(F.col("id").cast("string"), F.lit("")), 8) % F.lit(salts))
    group, cell = ["none", "name"], ["none", "name", "size"]
    runs = rows.groupBy(*cell, "salt").agg(F.count("*").alias("n"))
    cells = runs.groupBy(*cell).agg(F.sum("n").alias("cell_n"))
    sources = cells.groupBy(*group).agg(F.sum(F.col("cell_n") * F.col("size")).alias("source_size"))
    sources = source_targets(sources, group, weights, cap).select(
        *group,
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        (hex_number(F.concat_ws(":", F.lit(seed), F.col("none").cast("string"), "name"), 4) / F.lit(65536.0)).alias("offset"),
    )
    in_source = Window.partitionBy(*group).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    in_cell = Window.partitionBy(*cell).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.coalesce(F.sum("cell_n").over(in_source), F.lit(0)).alias("cell_rank")).join(sources, group)
    starts = runs.join(cells, cell).select(*cell, "salt", "source_size", "target", "rate", "offset", (F.col("cell_rank") + F.coalesce(F.sum("n").over(in_cell), F.lit(0))).alias("start"))
    in_run = Window.partitionBy(*cell, "salt").orderBy("id", *(["tie"] if tie else []))
    ranked = rows.join(starts, [*cell, "salt"]).select("*", (F.col("start") + F.row_number().over(in_run) - 1).alias("rank"))
    crossed = F.floor(F.col("rate") * (F.col("rank") + 1) + F.col("offset")) - F.floor(F.col("rate") * F.col("rank") + F.col("offset"))
    copies = F.when(F.col("size") > 0, F.least(crossed, F.lit(cap))).otherwise(F.lit(0)).cast("bigint")
    return ranked.select(F.col("id").alias(id_column), "size", "source_size", "target", copies.alias("copies"), *(["tie"] if tie else [])).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken.

    Rows are known by a hash of all their columns (but those of a map type, which have none), so that rows of one
    hash are the same row several times. Their copies are summed up, each task keeps one of them before the one
    shuffle of the texts, and the row is put out as often as the sum says: no row of a repeated or null id waits
    for the others.
    """
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    tied = df.select(F.struct("*").alias("row"), F.xxhash64(*hashed).alias("tie"))
    named = tied.select(F.col(f"row.{id_column}").alias("id"), F.col(f"row.{text}").alias("text"), F.col(f"row.{source}").alias("source"), "tie")
    copies = systematic_mix(named, "id", "text", "source", tie="tie", **options).groupBy("tie").agg(F.sum("copies").alias("copies")).where("copies > 0")
    single = tied.groupBy("tie").agg(F.first("row").alias("row"))
    met = single.join(copies.hint("merge"), "tie").select("row", "copies")
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).select("row.*")
