"""Locators of pages, paragraphs, notes and sections in their normal forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------

PAGE_ORDINAL = r"(?i)^#?\s*\[?\s*(?:(?:pages?|pp?\.?)[\s:_=-]*)?0*(\d{1,6})\s*\]?$"
PARAGRAPH_ORDINAL = r"(?i)^#?\s*(?:(?:paragraphs?|paras?|pars?|¶)\.?\s*)?(?:(?:paragraph|para|par)[\s:_=-]*)?0*(\d{1,6})$"
PAGE_PREFIX = r"(?i)^(?:pages?|pp?\.?)[\s:_=-]*"
PARAGRAPH_PREFIX = r"(?i)^(?:paragraphs?|paras?|pars?)\.?[\s:_=-]*"
RANGE = r"(?i)^(\d{1,6})\s*(?:-|–|—|\.\.|to)\s*(\d{1,6})$"
FOOTNOTE_PREFIX = r"(?i)^(?:footnotes?|notes?|fn)\s*[#.:_-]?\s*"
SECTION_PREFIX = r"(?i)^(?:ss?\.?|sections?)\s*"
#: Longest compatibility form of a character that is spelled out.
LONGEST_FORM = 4

# ----------------------------------------------------------------------------------------------------


def _compatible() -> tuple[str, str, dict[str, str]]:
    """Characters of the basic plane whose compatibility form is one other character, those forms, and the longer forms."""
    forms = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0x80, 0xD800)) if not unicodedata.combining(c)}
    forms |= {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xF900, 0x10000)) if not unicodedata.combining(c)}
    single = {c: f for c, f in forms.items() if f != c and len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in forms.items() if 1 < len(f) <= LONGEST_FORM}


_SINGLE, _PLAIN, _LONGER = _compatible()


def compatible(raw: Column) -> Column:
    """Compatibility forms of characters: full-width and raised digits, ligatures, fractions, other spaces.

    Each character by itself: letters and combining marks are not composed. Texts without such characters are left
    as they are without being looked at character by character.
    """
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{form}" for c, form in _LONGER.items())), F.lit("\x01"), F.lit("\x02"))
    translated = F.translate(raw, _SINGLE, _PLAIN)
    spelled = F.array_join(F.transform(F.split(translated, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.when(~raw.rlike(r"[^\x00-\x7F]"), raw).when(translated.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in _LONGER) + "]"), spelled).otherwise(translated)


def ordinal(kind: Column, raw: Column) -> Column:
    """The number of a page or paragraph locator; null if it is none."""
    return plain_ordinal(kind, compatible(raw))


def plain_ordinal(kind: Column, raw: Column) -> Column:
    """ordinal() of a locator in its compatibility form."""
    value = F.trim(raw)
    found = lambda p: F.when(value.rlike(p), F.regexp_extract(value, p, 1).cast("int"))
    return F.when(kind == "page", found(PAGE_ORDINAL)).otherwise(found(PARAGRAPH_ORDINAL))


def numeric_range(kind: Column, raw: Column) -> Column:
    """first and last of a locator such as 3-5; null if it is no range."""
    return plain_range(kind, compatible(raw))


def plain_range(kind: Column, raw: Column) -> Column:
    """numeric_range() of a locator in its compatibility form."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.trim(raw), "^#+", "")), r"^\[+", ""), r"\]+$", ""))
    bare = F.when(kind == "page", F.regexp_replace(bare, PAGE_PREFIX, "")).otherwise(F.regexp_replace(bare, PARAGRAPH_PREFIX, ""))
    return F.when(bare.rlike(RANGE), F.struct(F.regexp_extract(bare, RANGE, 1).cast("int").alias("first"), F.regexp_extract(bare, RANGE, 2).cast("int").alias("last")))


def footnote_key(raw: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(raw), FOOTNOTE_PREFIX, ""))


def section_key(raw: Column) -> Column:
    """A section's key: the prefix goes, then white space, then case; the collapsed text where nothing is left.

    The prefix pattern takes the single s first, so that "section 16" and "Section 16" have one key and "s. 16"
    has another. Labels and requests go through the same form.
    """
    return plain_section_key(compatible(raw))


def plain_section_key(raw: Column) -> Column:
    """section_key() of a locator in its compatibility form."""
    compact = F.lower(F.regexp_replace(F.regexp_replace(F.trim(raw), SECTION_PREFIX, ""), r"\s+", ""))
    return F.when(compact != "", compact).otherwise(F.lower(F.trim(F.regexp_replace(raw, r"\s+", " "))))
