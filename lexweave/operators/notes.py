"""Footnotes: cross references between notes, anchors in paragraphs, propositions and the pairing of marks with labels."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import shapes as S

_MARK = re.compile(S.PATTERNS["note_marker"])
_CROSSREF = re.compile(S.PATTERNS["crossref"])
#: A sentence ends at a stop with closing quotes, and the marks that follow it, before white space.
_SENTENCE_END = re.compile(r"[.!?][\"'”’)\]]*(?:⟦FN:[^⟧]+⟧)*(?=\s|$)")


def crossrefs(notes: DataFrame) -> DataFrame:
    """References of notes (doc_id, pair_id, label, body, restart_sequence) to others by number.

    A number that one note of the document has is its target; else one note of the same sequence; else the
    reference is resolved without a target, or unresolved where no note has the number.
    """

    def rows(batches):
        for batch in batches:
            at, found = [], []
            for k, body in enumerate(batch.column("body").to_pylist()):
                for n, m in enumerate(_CROSSREF.finditer(body or "")):
                    at.append(k)
                    found.append((n, (m[1] or "").lower() or ("op_cit" if m[2] else "see_footnote"), int(m[4]), m.start(), m.end()))
            index = pa.array(at, pa.int64())
            cols = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(index) for c in ("doc_id", "pair_id", "restart_sequence")] + [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()))],
                names=["doc_id", "pair_id", "restart_sequence", "seq", "kind", "number", "start", "end"],
            )

    kind = notes.schema["doc_id"].dataType.simpleString()
    asked = notes.where(F.col("body").rlike(r"(?i)supra|infra|op\.?\s*cit|footnote"))
    found = asked.select("doc_id", "pair_id", F.col("restart_sequence").cast("int").alias("restart_sequence"), "body").mapInArrow(rows, f"doc_id {kind}, pair_id string, restart_sequence int, seq int, kind string, number int, start int, end int")
    numbered = notes.where(F.col("label").rlike("^[0-9]{1,9}$")).select("doc_id", F.col("label").cast("int").alias("number"), F.col("restart_sequence").cast("int").alias("restart_sequence"), "pair_id")
    everywhere = numbered.groupBy("doc_id", "number").agg(F.count("*").alias("n"), F.min("pair_id").alias("only"))
    scoped = numbered.groupBy("doc_id", "number", "restart_sequence").agg(F.count("*").alias("n_here"), F.min("pair_id").alias("only_here"))
    met = found.join(everywhere, ["doc_id", "number"], "left").join(scoped, ["doc_id", "number", "restart_sequence"], "left")
    target = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_here") == 1, F.col("only_here")).otherwise(F.lit(""))
    return met.select("doc_id", F.col("pair_id").alias("source_pair_id"), "seq", "kind", "number", "start", "end", F.col("n").isNotNull().alias("resolved"), target.alias("target_pair_id"), F.coalesce("n", F.lit(0)).alias("target_count"))


def renumbered(paragraphs: DataFrame) -> DataFrame:
    """Marks ⟦FN:id⟧ of paragraphs as rows: doc_id, ordinal, pair_id, note number of its first use, offset in the bare text."""
    cut = paragraphs.select("doc_id", "ordinal", F.posexplode(F.split("text", "(?=⟦FN:)")).alias("part", "piece"))
    bare = F.length(F.regexp_replace("piece", S.PATTERNS["note_marker"], ""))
    before = Window.partitionBy("doc_id", "ordinal").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    marks = cut.select("doc_id", "ordinal", "part", F.regexp_extract("piece", "^⟦FN:([^⟧]+)⟧", 1).alias("pair_id"), F.coalesce(F.sum(bare).over(before), F.lit(0)).alias("offset")).where("pair_id <> ''")
    first = marks.groupBy("doc_id", "pair_id").agg(F.min(F.struct("ordinal", "part")).alias("first"))
    number = first.select("doc_id", "pair_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("note_number"))
    return marks.join(number, ["doc_id", "pair_id"]).select("doc_id", "ordinal", "pair_id", "note_number", "offset")


def propositions(paragraphs: DataFrame) -> DataFrame:
    """The sentence around each note mark and the passage since the mark before it: doc_id, pair_id, sentence, passage."""

    def rows(batches):
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                last = 0
                for m in _MARK.finditer(text or ""):
                    ends = [0, *(e.end() for e in _SENTENCE_END.finditer(text)), len(text)]
                    begin = max(e for e in ends if e <= m.start())
                    sentence = _MARK.sub("", text[begin : min(e for e in ends if e >= m.end())]).strip()
                    at.append(k)
                    out.append((m[0][4:-1], sentence, _MARK.sub("", text[last : m.start()]).strip()))
                    last = m.end()
            index = pa.array(at, pa.int64())
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(index), batch.column("ordinal").take(index), *(pa.array(c, pa.string()) for c in cols)], names=["doc_id", "ordinal", "pair_id", "sentence", "passage"])

    kind = paragraphs.schema["doc_id"].dataType.simpleString()
    return paragraphs.where(F.col("text").contains("⟦FN:")).select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "text").mapInArrow(rows, f"doc_id {kind}, ordinal int, pair_id string, sentence string, passage string")


def best_chain(items: list[tuple[int, int, float]]) -> list[int]:
    """Positions of the chain of labels with the greatest score: values rise, places rise, gaps cost.

    items: (value, place, score) in order of place. A gap of k missing values costs k / 4. The best chain that ends
    below a value is a prefix maximum over values of (its score + value / 4), kept in a binary indexed tree, so that
    n items take n log n steps. Of equal chains the one whose last label stands later goes on.
    """
    values = sorted({v for v, _, _ in items})
    rank = {v: k + 1 for k, v in enumerate(values)}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(values) + 1)
    best: list[tuple[float, int]] = []
    for i, (value, _, score) in enumerate(items):
        k, top = rank[value] - 1, (float("-inf"), -1)
        while k:
            top = max(top, tree[k])
            k -= k & -k
        gain = top[0] - (value - 1) / 4
        best.append((score + max(gain, 0.0), top[1] if gain > 0 else -1))
        entry, k = (best[-1][0] + value / 4, i), rank[value]
        while k < len(tree):
            tree[k] = max(tree[k], entry)
            k += k & -k
    if not best:
        return []
    at = max(range(len(best)), key=lambda i: best[i][0])
    out = []
    while at >= 0:
        out.append(at)
        at = best[at][1]
    return out[::-1]


def pair_notes(labels: DataFrame, references: DataFrame) -> DataFrame:
    """Pairs note labels with reference marks of a document: labels form rising chains, each takes the nearest mark.

    labels: doc_id, value, page_index, place, score, label_id; references: doc_id, value, page_index, place,
    ref_id. Chains are taken one after another until no label is left; a mark pairs with the label of its
    value on the same or the next page, the nearest first, each mark once. Rows: doc_id, chain, value,
    label_id, ref_id (null where no mark is found).
    """
    kind = labels.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("chain", pa.int32()), ("value", pa.int32()), ("label_id", pa.string()), ("ref_id", pa.string())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        rest = sorted(left.select(["place", "value", "page_index", "score", "label_id"]).to_pylist(), key=lambda r: (r["place"], r["label_id"]))
        marks: dict[int, list[dict]] = {}
        for r in sorted(right.to_pylist(), key=lambda r: (r["place"], r["ref_id"])):
            marks.setdefault(r["value"], []).append(r)
        out, chain = [], 0
        while rest:
            taken = best_chain([(r["value"], r["place"], r["score"]) for r in rest])
            for k in taken:
                label = rest[k]
                near = [m for m in marks.get(label["value"], []) if label["page_index"] - 1 <= m["page_index"] <= label["page_index"]]
                mark = min(near, key=lambda m: (label["page_index"] - m["page_index"], abs(label["place"] - m["place"]), m["ref_id"]), default=None)
                if mark:
                    marks[label["value"]].remove(mark)
                out.append((chain, label["value"], label["label_id"], mark and mark["ref_id"]))
            rest = [r for k, r in enumerate(rest) if k not in set(taken)]
            chain += 1
        doc = left.column("doc_id")[0] if left.num_rows else right.column("doc_id")[0]
        cols = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array([doc.as_py()] * len(out), left.schema.field("doc_id").type), *(pa.array(c, f.type) for c, f in zip(cols, schema))], names=["doc_id", *schema.names])

    l = labels.select("doc_id", F.col("value").cast("int").alias("value"), F.col("page_index").cast("int").alias("page_index"), F.col("place").cast("bigint").alias("place"), F.col("score").cast("double").alias("score"), F.col("label_id").cast("string").alias("label_id"))  # noqa: E741
    r = references.select("doc_id", F.col("value").cast("int").alias("value"), F.col("page_index").cast("int").alias("page_index"), F.col("place").cast("bigint").alias("place"), F.col("ref_id").cast("string").alias("ref_id"))
    return l.groupBy("doc_id").cogroup(r.groupBy("doc_id")).applyInArrow(task, f"doc_id {kind}, chain int, value int, label_id string, ref_id string")


def unmatched(anchors: DataFrame, superscripts: DataFrame) -> DataFrame:
    """Reference marks (doc_id, line_id, label) without an anchor."""
    return superscripts.join(anchors.select("doc_id", "line_id", "label").distinct(), ["doc_id", "line_id", "label"], "left_anti")


def repeated_references(primary: DataFrame, references: DataFrame) -> DataFrame:
    """Later marks with the value of a paired one: doc_id, value, ref_id, primary_id."""
    first = primary.select("doc_id", "value", F.col("ref_id").alias("primary_id"), F.col("place").alias("primary_place"))
    return references.join(first, ["doc_id", "value"]).where(F.col("place") > F.col("primary_place")).select("doc_id", "value", "ref_id", "primary_id")
