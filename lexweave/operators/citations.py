"""Citations in provision texts, their targets, relations and resolution."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions import patterns as P

_ORDINALS = P.ordinal_words()
_PASSES = {name: P.compiled(pattern, True) for name, pattern in (("proviso", P.CITE_PROVISO), ("explanation", P.CITE_EXPLANATION), ("reverse", P.CITE_REVERSE), ("rule", P.CITE_RULE), ("forward", P.CITE_FORWARD))}
#: A form cannot occur in a text without its word.
_WORDS = {"proviso": "proviso", "explanation": "explanation", "reverse": "section", "rule": "rule", "forward": "section"}
_ACT = P.compiled(P.EXTERNAL_ACT, True)
_CONTINUED = P.compiled(P.CITE_CONTINUED)
_CLAUSE_START = re.compile(r",|[.;](?=\s|$)")
_CLAUSE_END = re.compile(r"[,;]|\.(?=\s|$)")
_CONNECTIVE = re.compile(r" (?:and|but|or) ")

CITATION = T.StructType(
    [
        T.StructField("raw_text", T.StringType()),
        T.StructField("span_start", T.IntegerType()),
        T.StructField("span_end", T.IntegerType()),
        T.StructField("target_eid", T.StringType()),
        T.StructField("relation", T.StringType()),
        T.StructField("external", T.BooleanType()),
        T.StructField("target_type", T.StringType()),
    ]
)


def ordinal(word: str) -> int | None:
    """The number of an ordinal word, or None; three kinds of hyphen join compounds."""
    parts = [p for p in re.split("[-‐’]", word.lower()) if p]
    return _ORDINALS.get("-".join(parts)) if len(parts) in (1, 2) else None


def _path(*levels: tuple[str, str | None]) -> str:
    return "__".join(f"{kind}_{number.lower()}" for kind, number in levels if number)


def _target(kind: str, m: re.Match) -> str | None:
    """The eId that a match names; None where its ordinal cannot be read."""
    g = m.groupdict()
    if kind == "rule":
        return _path(("rule", g["rule"]), ("subrule", g["before"] or g["after"]))
    section = ("sec", g["sec"]), ("subsec", g["subsec"])
    if kind == "proviso":
        word = g["ord"]
        count = 1 if word is None else ordinal(word) or (1 if word.lower() in P.NON_ORDINALS else None)
        return count and f"{_path(*section)}__proviso_{count}"
    if kind == "explanation":
        return f"{_path(*section, ('cl', g['cl']))}__expl" + (f"_{g['expl']}" if g["expl"] else "")
    return _path(*section, ("cl", g["cl"]), ("subcl", g["subcl"]))


def relation(text: str, start: int, end: int) -> str:
    """The nearer of "notwithstanding" and "subject to" inside the citation's own clause."""
    begin = 0
    for m in _CLAUSE_START.finditer(text, 0, start):
        if m.group() == "," or m.end() == start or text[m.end()].isspace():
            begin = m.end()
    tail = text[end:]
    stops = [m.start() for m in (_CLAUSE_END.search(tail), _CONNECTIVE.search(tail)) if m]
    clause = text[begin : end + min(stops, default=len(tail))].lower()
    against, under = clause.rfind("notwithstanding"), clause.rfind("subject to")
    if against < 0 and under < 0:
        return "reference"
    return "subject_to" if under > against else "notwithstanding"


def find_citations(text: str | None) -> list[dict]:
    """All citations of a text in order of their start.

    Forms are looked for from the most specific to the least; a form does not claim characters that an
    earlier form has. Spans are in characters.
    """
    text = text or ""
    folded = text.casefold()
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern in _PASSES.items():
        if _WORDS[kind] not in folded:
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if kind != "proviso" and any(start < b and a < end for a, b in taken):
                continue
            if kind == "reverse" and text[end:].lstrip().startswith("("):
                continue
            target = _target(kind, m)
            if target is None:
                continue
            act = _ACT.match(text, end)
            end = act.end() if act else end
            external = bool(act) or kind == "rule"
            how = relation(text, start, end)
            taken.append((start, end))
            made = {"raw_text": text[start:end], "span_start": start, "span_end": end, "target_eid": target, "relation": how, "external": external, "target_type": "rule" if kind == "rule" else "external_act" if act else None}
            out.append(made)
            at = end
            for _ in range(P.MOST_CONTINUED if kind == "forward" else 0):
                more = _CONTINUED.match(text, at)
                if not more:
                    break
                at = more.end()
                taken.append(more.span(1))
                out.append(made | {"raw_text": more[1], "span_start": more.start(1), "span_end": more.end(1), "target_eid": _path(("sec", more[1])), "external": False, "target_type": None})
    return sorted(out, key=lambda c: c["span_start"])


def extract_citations(provisions: DataFrame, eid: str = "eid", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each citation: kept columns, parent_eid, cite_seq, then the citation's fields."""
    schema = T.StructType([*(provisions.schema[c] for c in keep), T.StructField("parent_eid", T.StringType()), T.StructField("cite_seq", T.IntegerType()), *CITATION.fields])
    types = {f.name: t for f, t in zip(CITATION.fields, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()))}

    def rows(batches):
        for batch in batches:
            at, found = [], []
            for k, t in enumerate(batch.column("_text").to_pylist()):
                for n, c in enumerate(find_citations(t)):
                    at.append(k)
                    found.append(c | {"n": n})
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(index) for c in keep), batch.column("parent_eid").take(index), pa.array([c["n"] for c in found], pa.int32()), *(pa.array([c[n] for c in found], t) for n, t in types.items())],
                names=schema.names,
            )

    # A text without any of the three words holds no citation and need not leave the JVM.
    asked = provisions.where(F.col(text).rlike("(?i)section|rule|proviso"))
    return asked.select(*keep, F.col(eid).alias("parent_eid"), F.col(text).alias("_text")).mapInArrow(rows, schema)


def resolve(citations: DataFrame, provisions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds resolved: an internal citation whose target exists in the same document. Externals never resolve."""
    table = provisions.select(*keys, F.col("eid").alias("target_eid")).distinct().withColumn("_found", F.lit(True))
    joined = citations.join(table, [*keys, "target_eid"], "left")
    return joined.withColumn("resolved", ~F.col("external") & F.coalesce("_found", F.lit(False))).select(*citations.columns, "resolved")
