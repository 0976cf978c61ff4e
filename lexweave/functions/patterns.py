"""Fixed values of the statute grammar: word lists, patterns and formats that results depend on."""

from __future__ import annotations

import re

# --- Fixed values -----------------------------------------------------------------------------------

SECTION_NUMERAL = r"[0-9]+[A-Za-z]*"
CLAUSE_TOKEN = r"[a-z]{1,2}"
SUBCLAUSE_TOKEN = r"[ivx]+"

SECTION = r"^(?:\[\d+\])?(?:\d+\[)?\[?\s*(?:Section\s+([0-9]+[A-Za-z]*)|([0-9]{1,3}[A-Za-z]*))\.(.*)$"
SUBSECTION = rf"^\(({SECTION_NUMERAL})\)\s*(.*)$"
CLAUSE = r"^\(([a-zA-Z]{1,2})\)\s*(.*)$"
SUBCLAUSE = rf"^\(({SUBCLAUSE_TOKEN})\)\s*(.*)$"
PROVISO = r"^(Provided(?:\s+(?:also|always|even\s+further|further|hereinbefore|therein))*\s*,?\s*(?:that\b)?)(.*)$"
EXPLANATION = r"^Explanation(?:\s+([0-9]+))?(?:\.—|\.-|—|-|:|\.)\s*(.*)$"
NOTE_LEAD = r"(?:Subs\.|Ins\.|Substituted|Inserted|Omitted|The\s+words|Amended|w\.e\.f\.)"
NOTE_LINE = rf"(?i)^([0-9]+)\.?\s*{NOTE_LEAD}.*$"
NOTE_TAIL = (
    r"(?i)^\s*(?:\(\s*no\.\s*[0-9]{1,3}\s+of\s+(?:19|20)[0-9]{2}\s*\)\s*)?[—–-]{1,3}\s*"
    r"(?:brought\s+into\s+force|come\s+into\s+force|force\s+came\s+into\s+force|commenced\s+on|with\s+effect\s+from|effective\s+from)\b"
)
DIVISION = (
    r"(?i:^(?:THE\s+)?(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENT)?\s*(?:CHAPTER|PART|SCHEDULE)S?(?:\s+[ivxlcdm]+)?)"
    r"(?:\s+[A-Z]{1,3}|\s+[0-9]{1,3})?(?:-\s?[A-Z]{1,3})?(?:\s*[:—–]+\s*\S.*)?\s*$"
)
DIVISION_TITLE = r"^[A-Z][A-Z0-9 ,.'()/&-]*[A-Z0-9)]$"
CONNECTORS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "per", "than", "that", "the", "this", "to", "under", "with", "which", "whose")
SENTENCE_OPENERS = ("the ", "a ", "an ", "it ", "this ", "that ", "these ", "those ", "no ", "nothing ", "every ", "any ", "where ", "when ")
MARGINAL_NOTE_BYTES = 96
MARGINAL_NOTE_VETOES = (". ", ";", "section ", "Section ", "Article", " rule", " Act")
#: Separators between a heading and its body, the more specific first; the colon needs an upper-case letter after it.
HEADING_SEPARATORS = ((".—", False), (".-", False), ("—", False), (":", True))

CITED_CLAUSE = rf"(?:clause\s*\((?P<cl>{CLAUSE_TOKEN})\)\s+of\s+)?"
CITED_SUBSECTION = rf"(?:sub-section\s*\((?P<subsec>{SECTION_NUMERAL})\)\s+of\s+)?"
CITED_SECTION = rf"section\s+(?P<sec>{SECTION_NUMERAL})\b"
CITE_PROVISO = rf"\b(?:(?P<ord>[a-z]+(?:[-'‑][a-z]+)?)\s+)?proviso\s+to\s+{CITED_CLAUSE}{CITED_SUBSECTION}{CITED_SECTION}"
CITE_EXPLANATION = rf"\bExplanation\s*(?P<expl>[0-9]+)?\s+to\s+{CITED_CLAUSE}{CITED_SUBSECTION}{CITED_SECTION}"
CITE_REVERSE = rf"\b(?:sub-clause\s*\((?P<subcl>{SUBCLAUSE_TOKEN})\)\s+of\s+)?{CITED_CLAUSE}{CITED_SUBSECTION}{CITED_SECTION}"
CITE_RULE = rf"\b(?:sub-rule\s*\((?P<before>{SECTION_NUMERAL})\)\s+of\s+)?rule\s+(?P<rule>{SECTION_NUMERAL})(?:\s*\((?P<after>{SECTION_NUMERAL})\)|\b)"
CITE_FORWARD = rf"\bsections?\s+(?P<sec>{SECTION_NUMERAL})\s*(?:\((?P<subsec>{SECTION_NUMERAL})\)(?:\s*\((?P<cl>{CLAUSE_TOKEN})\)(?:\s*\((?P<subcl>{SUBCLAUSE_TOKEN})\))?)?|\b)"
CITE_CONTINUED = r"\s*(?:,|and)\s*([0-9]+[A-Za-z]*)"
EXTERNAL_ACT = r"\s*of\s+the\s+([A-Z][a-zA-Z\s]+Act(?:,\s*[0-9]{4})?)"
MOST_CONTINUED = 3
NON_ORDINALS = ("the", "a", "an", "such", "aforesaid", "above", "following", "preceding")
UNITS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
IRREGULAR_ORDINALS = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}

EFFECTIVE_DATE = r"(?i)\(w\.e\.f\.\s*([^)]+)\)"
SUBSTITUTED_FOR = r"(?i),\s*for\s+[\"“](.*?)[\"”]"
AMENDING_SECTION = r"(?i)\b(?:s\.|section)\s*([0-9]+[A-Za-z]*)"
AMENDING_ACT = r"(?i)\bby\s+((?:Act\s+[0-9]+\s+of\s+[0-9]{4}|the\s+[^,]+Act(?:,\s*[0-9]{4})?))\b"

LONG_TITLE = r"(?i)\bTHE\s+([A-Z][A-Za-z0-9 ,.'()\-/&]{6,}?)\s+ACT,?\s*((?:19|20)[0-9]{2})\b"
ACT_NUMBER = r"\bAct\s+([0-9]+)\s+of\s+([0-9]{4})\b"
LOWER_TITLE_WORDS = ("and", "of", "the", "in", "on", "for", "to", "at", "by", "with")
FALLBACK_TITLE = "Indian Bare Act"
STATUTE_SCHEMA = "akn.statute.v1"

BAR, DOUBLE_BAR, LEFT_QUOTE, RIGHT_QUOTE = "―", "‖", "“", "”"
BROKEN_FONT_HITS = 8
REAL_QUOTE_FACTOR = 4

EDGE_TOP, EDGE_BOTTOM, EDGE_PAGES = 0.155, 0.84, 4

ROMAN_SCHEDULES = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
WORD_SCHEDULES = ("FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH")

# --- Compiled forms ---------------------------------------------------------------------------------


def compiled(pattern: str, ignore_case: bool = False) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE if ignore_case else 0)


def ordinal_words() -> dict[str, int]:
    """Every ordinal and cardinal word from 1 to 99 that a proviso may be counted by, built from the lists above."""
    base = {w: i + 1 for i, w in enumerate(UNITS)}
    base |= {w: 10 * i + 20 for i, w in enumerate(TENS)}
    base |= {w[:-1] + "ie": n for w, n in list(base.items()) if w in TENS}
    base |= IRREGULAR_ORDINALS
    single = dict(base)
    for word, n in base.items():
        for suffix in ("th", "st", "nd", "rd"):
            single.setdefault(word + suffix, n)
    pairs = {f"{tens}-{unit}": 10 * i + 20 + n for i, tens in enumerate(TENS) for unit, n in base.items()}
    return single | pairs
