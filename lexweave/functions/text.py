"""Text measures and normal forms as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------

NOTE_SYMBOLS = "*∗\uf02a†‡§¶#"
CANONICAL_SYMBOLS = ("∗\uf02a", "**")
FULL_QUALITY_CHARS = 100
REPLACEMENT_PENALTY = 20
PRINTABLE = r"[\p{L}\p{M}\p{N}\p{P}\p{S} ]"
ENGLISH_WORDS = ("the", "of", "and", "to", "in", "that", "is", "be", "for", "by", "with", "or", "any", "which", "shall", "not", "was", "this", "as", "it", "are", "from", "under", "were")
FRENCH_WORDS = ("le", "la", "les", "des", "du", "de", "et", "à", "au", "aux", "que", "qui", "une", "un", "est", "pour", "dans", "par", "sur", "ne", "pas", "il", "ou", "sont", "cette", "ces", "l", "d")
LANGUAGE_FACTOR = 3

# ----------------------------------------------------------------------------------------------------


def utf16_length(text: Column) -> Column:
    """Characters, with those beyond the basic plane counted twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def without_zero_widths(text: Column) -> Column:
    """Byte order marks go; two or more zero-width spaces become a space, a single one goes."""
    bare = F.translate(text, "﻿", "")
    return F.regexp_replace(F.regexp_replace(bare, "​{2,}", " "), "​", "")


def furniture_normal(text: Column) -> Column:
    """Digits become one #, white space one space, letters lower case; leading and trailing space goes."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"\d+", "#")), r"\s+", " "))


def note_label(text: Column) -> Column:
    """A label with its digits and symbols in their plain form; numbers lose leading zeros."""
    plain = F.translate(F.translate(F.trim(text), *CANONICAL_SYMBOLS), "⁰¹²³⁴⁵⁶⁷⁸⁹０１２３４５６７８９", "01234567890123456789")
    return F.when(plain.rlike("^[0-9]{1,18}$"), plain.cast("bigint").cast("string")).otherwise(plain)


def label_prefix(text: Column) -> Column:
    """The note label at a line's start, or the label that the whole line is; null where there is none."""
    symbols = "[" + NOTE_SYMBOLS + "]"
    at_start = rf"^\s*({symbols}{{1,8}}|[0-9]{{1,4}})(?:\s|[.)\],:;-](?:\s|$))"
    alone = rf"^\s*({symbols}{{1,8}}|[0-9]{{1,4}})\s*$"
    return F.when(text.rlike(at_start), note_label(F.regexp_extract(text, at_start, 1))).when(text.rlike(alone), note_label(F.regexp_extract(text, alone, 1)))


def compact_note_line(text: Column) -> Column:
    """A label followed by at least four letters."""
    rest = F.regexp_replace(text, r"^\s*(?:[" + NOTE_SYMBOLS + r"]{1,8}|[0-9]{1,4})[\s.)\],:;-]*", "")
    return label_prefix(text).isNotNull() & ~text.rlike(r"^\s*(?:[" + NOTE_SYMBOLS + r"]{1,8}|[0-9]{1,4})\s*$") & (F.length(F.regexp_replace(rest, r"[^\p{L}]", "")) >= 4)


def joined_lines(lines: Column) -> Column:
    """Lines as running text: trimmed, blank ones dropped, a hyphen before a lower-case letter closed up."""
    # F.trim itself would take the line's index as the characters to trim.
    kept = F.filter(F.transform(lines, lambda t: F.trim(t)), lambda t: t != "")

    def step(done: Column, t: Column) -> Column:
        closes = done.endswith("-") & t.rlike(r"^\p{Ll}")
        return F.when(closes, F.concat(F.substring(done, F.lit(1), F.length(done) - 1), t)).when(done == "", t).otherwise(F.concat(done, F.lit(" "), t))

    return F.aggregate(kept, F.lit(""), step)


def text_quality(lines: Column) -> Column:
    """Share of printable characters, less for short pages and for replacement characters; 4 places, ties to even."""
    whole = F.array_join(lines, "\n")
    count = F.greatest(F.length(whole), F.lit(1))
    # The separators between lines count as characters but not as printable ones.
    printable = F.regexp_count(whole, F.lit(PRINTABLE)) / count
    replaced = F.regexp_count(whole, F.lit("�")) / count
    amount = F.least(F.length(F.regexp_replace(whole, r"^\s+|\s+$", "")) / F.lit(FULL_QUALITY_CHARS), F.lit(1.0))
    return F.bround(F.greatest(amount * printable * (1 - F.least(replaced * REPLACEMENT_PENALTY, F.lit(1.0))), F.lit(0.0)), 4)


def stopword_votes(text: Column, words: tuple[str, ...]) -> Column:
    """How many words of a text are in a list."""
    return F.size(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*words)))


def column_language(english: Column, french: Column, minimum: int) -> Column:
    """fr or en where its votes reach the minimum and three times the other's; else null."""
    return F.when((french >= minimum) & (french >= english * LANGUAGE_FACTOR), "fr").when((english >= minimum) & (english >= french * LANGUAGE_FACTOR), "en")
