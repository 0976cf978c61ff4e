"""Inputs made from the driver's tables by expressions that Spark and DuckDB read alike.

The driver's tables hold no legal text. A table here is a base table and stages of named expressions; Spark
selects them, SQL twins nest them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Made:
    """A base table and the stages over it."""

    base: str
    stages: tuple[dict[str, str], ...]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, self.base)
        for stage in self.stages:
            df = df.selectExpr(*(e if n == "*" else f"{e} AS {n}" for n, e in stage.items()))
        return df

    @property
    def sql(self) -> str:
        out = self.base
        for stage in self.stages:
            out = f"(SELECT {', '.join(e if n == '*' else f'{e} AS {n}' for n, e in stage.items())} FROM {out})"
        return f"(SELECT * FROM {out})"

    def over(self, sql: str, name: str = "t") -> str:
        """A query over the table under a name."""
        return f"WITH {name} AS {self.sql} {sql}"


NUMBERED = {"*": "*", "rn": "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)"}

#: Ten lines a page: a running head, a heading, body lines, a note and a folio.
LINES = Made(
    "lineitem",
    (
        NUMBERED,
        {
            "doc_id": "l_suppkey",
            "page_index": "CAST(floor((rn - 1) / 10) AS INT)",
            "page_number": "CAST(floor((rn - 1) / 10) AS INT) + 1",
            "reading_order": "CAST((rn - 1) % 10 AS INT)",
            "line_id": "concat('l', rn + 1000000)",
            "block_index": "CAST(floor(((rn - 1) % 10) / 3) AS INT)",
            "region_type": "CASE (rn - 1) % 10 WHEN 0 THEN 'header' WHEN 9 THEN 'footer' WHEN 8 THEN 'footnote' WHEN 3 THEN 'heading' ELSE 'body' END",
            "text": "CASE (rn - 1) % 10 WHEN 0 THEN concat('Revenue Act of ', 1990 + l_suppkey % 5) WHEN 9 THEN concat('- ', CAST(floor((rn - 1) / 10) AS INT) + 1, ' -')"
            " WHEN 8 THEN concat(l_linenumber, ' See supra note ', l_partkey % 9 + 1, ' and infra, note ', l_partkey % 4 + 1, '.') WHEN 3 THEN concat(chr(CAST(65 + l_partkey % 5 AS INT)), '. GENERAL PART')"
            " ELSE concat('Subject to sub-section (', l_linenumber, ') of section ', l_partkey % 9 + 1, ', the levy ', l_partkey, CASE WHEN l_partkey % 7 = 0 THEN ' exam-' WHEN l_partkey % 5 = 0 THEN ' Ends here.' ELSE ' continues' END) END",
            "x0": "CAST((l_partkey % 40) * 10 AS DOUBLE)",
            "x1": "CAST((l_partkey % 40) * 10 + 40 + l_linenumber * 20 AS DOUBLE)",
            "y0": "CAST(((rn - 1) % 10) * 78 + 12 AS DOUBLE)",
            "y1": "CAST(((rn - 1) % 10) * 78 + 24 + l_linenumber % 3 AS DOUBLE)",
            "size": "CAST(8 + l_partkey % 6 AS DOUBLE)",
            "k": "l_partkey",
            "n": "CAST(l_linenumber AS INT)",
        },
    ),
)

#: Sections in order, each with a sub-section that cites another.
STATUTES = Made(
    "lineitem",
    (
        {"*": "*", "rn": NUMBERED["rn"].replace("PARTITION BY l_suppkey ORDER BY l_orderkey", "PARTITION BY l_orderkey ORDER BY l_suppkey")},
        {
            "doc_id": "l_orderkey",
            "seq": "CAST(rn AS INT)",
            "target": "CAST(l_partkey % 9 + 1 AS INT)",
            "kind": "CAST(l_suppkey % 4 AS INT)",
            "text": "concat(rn, '. Levy of item ', l_partkey, '.—(1) ', CASE l_suppkey % 4 WHEN 0 THEN concat('Notwithstanding anything in sub-section (1) of section ', l_partkey % 9 + 1) WHEN 1 THEN concat('Subject to section ', l_partkey % 9 + 1, '(1)')"
            " WHEN 2 THEN concat('As provided in rule ', l_partkey % 9 + 1, '(4)') ELSE concat('Under section ', l_partkey % 9 + 1, ' of the Central Excise Act, 1944') END, '; tax is due.')",
        },
    ),
)


#: A section's lines by the kind of the section (0 to 5), with the target of its citation.
SECTION_LINES = {
    0: "concat(rn, '. Levy.—(1) Tax is due on item ', l_partkey, ';', chr(10), '(a) as the proviso to section ', target, ' says;', chr(10), '(i) sub one', chr(10), '(ii) sub two', chr(10), '(b) second clause')",
    1: "concat(rn, '. Rates.—Flat rate ', l_partkey, chr(10), 'Provided that Explanation 2 to clause (b) of section ', target, ' holds', chr(10), 'Provided further that it is none')",
    2: "concat(rn, '. Meaning.—(1) clause (b) of sub-section (2) of section ', target, ' is read', chr(10), '(2) two', chr(10), 'Explanation.—three', chr(10), 'Explanation 2.—four')",
    3: "concat(rn, '. Plain.—1[Text under rule ', target, '(4)', chr(10), 'goes further]')",
    4: "concat(rn, '. Twice.—(1) section ', target, '(1)(a)(i) has it', chr(10), '(1) as section ', target, ' of the Central Excise Act, 1944 has it')",
    5: "concat(rn, '. Main.—Subject to section ', target, '(2), it ends', chr(10), rn, 'A. Inserted.—New')",
}
#: Whole Acts: front matter, chapters, sections of six kinds, a schedule and a footnote. One row for each section.
ACTS = Made(
    "lineitem",
    (
        {"*": "*", "rn": NUMBERED["rn"].replace("PARTITION BY l_suppkey ORDER BY l_orderkey", "PARTITION BY l_orderkey ORDER BY l_suppkey"), "top": "count(*) OVER (PARTITION BY l_orderkey)"},
        {"*": "*", "kind": "CAST((l_partkey + rn) % 6 AS INT)", "target": "CAST(l_partkey % 7 + 1 AS INT)"},
        {
            "doc_id": "l_orderkey",
            "seq": "CAST(rn AS INT)",
            "top": "CAST(top AS INT)",
            "kind": "kind",
            "target": "target",
            "k": "l_partkey",
            "text": "concat(CASE WHEN rn = 1 THEN concat('THE LEVY OF ITEMS ACT, ', 2000 + l_orderkey % 20, chr(10), 'Act 12 of ', 2000 + l_orderkey % 20, chr(10), 'CHAPTER I', chr(10), 'PRELIMINARY', chr(10)) WHEN rn = 4 THEN concat('CHAPTER II', chr(10), 'RATES', chr(10)) ELSE '' END, CASE kind "
            + " ".join(f"WHEN {k} THEN {e}" for k, e in SECTION_LINES.items())
            + " END, CASE WHEN rn = top THEN concat(chr(10), 'SCHEDULE I', chr(10), '1. first item', chr(10), '(a) inside', chr(10), '2. second item', chr(10), '1. Subs. by Act 12 of 2020, s. 118, for \"old\" (w.e.f. 1-1-2021).') ELSE '' END)",
        },
    ),
)


def act_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ACTS as the statute reader takes them."""
    cut = ACTS.frame(spark, sf_dir).select("doc_id", F.col("seq").alias("section"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return cut.select("doc_id", (F.col("section") * 100 + F.col("at")).alias("seq"), "text", F.lit(1).alias("page_number"), F.lit("unknown").alias("note_class"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES with boxes and spans as the library's operators take them."""
    df = LINES.frame(spark, sf_dir)
    return df.withColumn("bbox", F.struct("x0", "y0", "x1", "y1")).withColumn("exclude_from_body", F.lit(False))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of LINES, 600 by 800."""
    return LINES.frame(spark, sf_dir).select("doc_id", "page_index", "page_number").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})


#: A line for each shape, and some for none.
EXAMPLES = (
    "IV.", "b) The rule", "[12]", "- 7 -", "page 12", "xiv", "*", "Levy ....... 4", "a . . . b", "It ended.", "It goes on", "(3) an item", "Notes", "Endnotes (continued)", "Schedule IV", "12 June 2020",
    "Dated this 4th day of March 2019", "exam-", "ple of it", "Table 4 shows", "see Figure 2", "[4] 12:7 and more", "12 S.C.R. (2d) 45", "[1999] 2 SCR", "see p.", "II. Title", "1. item one", "12 Note text",
    "supra, as noted at 14", "GENERAL PART", "General Part of the Act", "Levy, and", "Levy for the", "an open (bracket", "3.2.1. Deep", "1a2b", "the quick brown fox jumps over dogs", "Part of the value of supply",
)
EXAMPLE_LINES = Made(
    "lineitem",
    (
        NUMBERED,
        {
            "doc_id": "l_suppkey",
            "line_id": "concat('l', rn + 1000000)",
            "text": f"CASE (rn + l_partkey) % {len(EXAMPLES)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(EXAMPLES)) + " END",
        },
    ),
)
