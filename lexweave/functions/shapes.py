"""Predicates on the shape of a line, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------

MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[ée]cembre)"
RUN_ON_WORDS = (
    "A", "AN", "THE", "AND", "OR", "NOR", "BUT", "OF", "FOR", "TO", "IN", "ON", "AT", "BY", "WITH", "FROM", "INTO", "UPON", "UNDER", "OVER", "THROUGH", "BETWEEN", "AGAINST", "ABOUT", "AS",
    "V", "VS", "VERSUS", "INCLUDING", "REGARDING", "CONCERNING", "WITHIN", "WITHOUT", "&", "DE", "DU", "DES", "LA", "LE", "LES", "ET", "EN", "AU", "AUX", "POUR", "SUR", "PAR",
)
PATTERNS = {
    "standalone_enumerator": r"^\s*([IVXLCDM]{1,7}|[A-Za-z]|\d{1,3}|\d{1,2}(?:\.\d{1,2}){1,3})([.)])\s*$",
    "inline_enumerator": r"^\s*([IVXLCDM]{1,7}|[A-Za-z]|\d{1,3}|\d{1,2}(?:\.\d{1,2}){1,3})([.)])\s+(\S.*)$",
    "paragraph_number": r"^\s*\[\s*\d{1,3}\s*\]\s*$",
    "arabic_folio": r"^\s*-?\s*(\d{1,4})\s*-?\s*$",
    "printed_label": r"(?i)^(?:(?:page\s+)?(\d{1,6}|[ivxlcdm]{1,12})|-\s*(\d{1,6})\s*-)$",
    "footer_page_number": r"(?i)^\s*-?\s*(?:page\s+)?[ivxlcdm\d]+\s*-?\s*$",
    "standalone_reference": r"^(?:\d{1,4}|[*†‡§¶#])$",
    "dot_leader": r"\.{4,}|(?:\. ){3,}|…",
    "contents_leader": r"(?:\. ){3,}|\.{4,}",
    "sentence_ended": r"[.!?][\"')\]]*$",
    "list_opener": r"^\s*(?:[-*]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)]|[IVXLCDMivxlcdm]{1,8}[.)]|§)\s+\S",
    "notes_heading": r"(?i)^(?:end)?notes?$",
    "note_section_heading": r"(?i)^(?:endnotes?|footnotes?|notes?)(?:\s*\(?(?:continued|cont'd)\)?)?$",
    "back_matter_heading": r"(?i)^(?:appendix|annex|schedule|part|chapter|bibliography|references|works\s+cited|table\s+of\s+authorities|index|acknowledg(?:e)?ments|certificate\s+of\s+service|about\s+the\s+authors?)(?:\s+[\w.-]+)?$",
    "date_line": rf"(?iu)^(?:dated\s+(?:this\s+)?|le\s+)?(?:\d{{1,2}}(?:st|nd|rd|th|er)?\s+(?:day\s+of\s+)?{MONTH}\.?,?\s+\d{{4}}|{MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}})$",
    "hyphen_tail": r"[A-Za-z]{2,}[-¬­]$",
    "hyphen_head": r"^[A-Za-z]{2,}",
    "table_caption": r"(?i)^(?:table|tableau)\s+(?:\d+|[ivxlcdm]+)\b",
    "note_label_alone": r"^\s*(?:[*∗†‡§¶#]{1,8}|\d{1,4})\s*$",
    "visual_cue": r"(?i)\b(?:diagram|figure|chart|table|graph|map|illustration|image|photo)",
    "index_entry": r"\[\d{1,3}\]\s+\d{1,4}[:/]\d{1,3}",
    "volume_citation": r"^\d{1,3}\s+[A-Z][A-Za-z]{0,5}\.(?:(?:\s+(?:&\s*)?|&\s*)[A-Z][A-Za-z]{0,5}\.?|[A-Z]\.)*\s*(?:\(\d{1,4}[a-z]{0,2}\)\s*)?(?:(?:c|ch|ss?)\.\s*)?\d{1,4}",
    "bracketed_year": r"^\[(?:1[5-9]|20)\d\d\]",
    "pinpoint_abbreviation": r"(?i)(?:^|[\s(\[])(?:pp?|paras?|ss?|secs?|arts?|vols?|nos?|c|ch|cc|pts?|eds?|figs?|tabs?|apps?|cls?)\.$",
    "roman_title": r"(?i)^\s*(?:I|II)[).]\s+",
    "list_item": r"^\s*(?:[•*.-]|\(?[A-Za-z0-9]{1,3}[).])\s+",
    "footnote_marker_line": r"^\s*(?:\(?\d{1,3}\)?[.)]?|[*†‡§¶]+)\s+\S",
    "heading_enumerator": r"^\s*(?:[IVXLC]{1,6}|[A-Za-z]|\d{1,2})\s*[.)]\s+\S",
    "numbered_supra": r"(?i)supra[^\n\r]{0,40}?[0-9]+",
    "sha256": r"^[0-9a-f]{64}$",
    "crossref": r"(?i)\b(?:(supra|infra),?\s+(?:foot)?notes?|(op)\.?\s*cit\.?,?\s+(?:foot)?notes?|(see)\s+(?:also\s+)?footnote)\s+(\d{1,3})\b",
    "note_marker": r"⟦FN:[^⟧]+⟧",
}
VISUAL_REGIONS = ("image", "chart", "header_image", "footer_image", "seal", "table")
NOTE_REGIONS = ("footnote", "vision_footnote", "reference", "reference_content")
PAGE_NUMBER_REGIONS = ("number", "formula_number")
ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

# --- Predicates -------------------------------------------------------------------------------------


def is_shape(name: str, text: Column) -> Column:
    """True where a text has one of the named shapes."""
    return text.rlike(PATTERNS[name])


def arabic_page_number(text: Column) -> Column:
    return F.when(is_shape("arabic_folio", text), F.regexp_extract(text, PATTERNS["arabic_folio"], 1).cast("int"))


def printed_page_label(text: Column) -> Column:
    """The label of a printed folio; null where the text is none."""
    trimmed = F.trim(text)
    label = F.concat(F.regexp_extract(trimmed, PATTERNS["printed_label"], 1), F.regexp_extract(trimmed, PATTERNS["printed_label"], 2))
    return F.when(is_shape("printed_label", trimmed), label)


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def all_caps(text: Column) -> Column:
    """Has letters, and all of them are upper case."""
    own = letters(text)
    return (own != "") & (own == F.upper(own))


def has_word_character(text: Column) -> Column:
    return text.rlike(r"(?U)\w")


def capitalised_share(text: Column) -> Column:
    """Share of the words with a letter that begin with an upper-case letter."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) / F.size(words)).otherwise(F.lit(0.0))


def title_runs_on(title: Column) -> Column:
    """A title's words go on past its line: a dash, comma, slash or ampersand, a run-on word or an open bracket."""
    bare = F.rtrim(title)
    last = F.upper(F.regexp_replace(F.element_at(F.split(bare, r"\s+"), -1), r"\.+$", ""))
    return bare.rlike(r"[,\-–—/&]$") | last.isin(*RUN_ON_WORDS) | (bracket_excess(bare) > 0)


def upper_share(text: Column) -> Column:
    """Share of the letters that are upper case."""
    own = letters(text)
    return F.when(own != "", F.length(F.regexp_replace(own, r"[^\p{Lu}]", "")) / F.length(own)).otherwise(F.lit(0.0))


def bracket_excess(text: Column) -> Column:
    """Opening brackets and quotes without a closing one, by a stack over the characters."""
    pairs = {"(": ")", "[": "]", "{": "}", "“": "”"}

    def step(stack: Column, c: Column) -> Column:
        top = F.substring(stack, F.length(stack), F.lit(1))
        closes = F.lit(False)
        for opening, closing in pairs.items():
            closes = closes | ((c == closing) & (top == opening))
        return F.when(c.isin(*pairs), F.concat(stack, c)).when(closes, F.substring(stack, F.lit(1), F.length(stack) - 1)).otherwise(stack)

    return F.length(F.aggregate(F.split(text, ""), F.lit(""), step))


def closes_before_opening(text: Column) -> Column:
    """Of the brackets and quotes among the first 48 characters the first one closes."""
    return F.substring(text, 1, 48).rlike(r"^[^(\[{“)\]}”]*[)\]}”]")


def prose_like(text: Column) -> Column:
    """Two lower-case words and a stop, or enough letters with a digit set against one."""
    sentence = (F.regexp_count(text, F.lit("[a-z]{2,}")) >= 2) & text.rlike("[.,;]")
    return sentence | ((F.length(letters(text)) >= 8) & text.rlike("[a-z][0-9]"))


def heading_shaped(text: Column) -> Column:
    """The letters among the first 40 characters are four or more capitals."""
    own = letters(F.substring(F.trim(text), 1, 40))
    return (F.length(own) >= 4) & (own == F.upper(own)) & own.rlike(r"^\p{Lu}+$")


def zone(region_type: Column) -> Column:
    """What a region's name says a line is: note, number, header, visual, title or body."""
    name = F.lower(region_type)
    has = lambda *words: name.rlike("|".join(words))
    return (
        F.when(has("footnote", "endnote", "reference_content", "note"), "note")
        .when(has("page_number", "number", "folio"), "number")
        .when(has("header", "running"), "header")
        .when(has("image", "figure", "chart", "graphic", "formula", "separator", "table", "photo"), "visual")
        .when(has("title", "heading", "byline", "abstract", "toc"), "title")
        .otherwise("body")
    )


def edge_folio(region_type: Column, text: Column) -> Column:
    return region_type.isin("header", "footer", "page_number", "folio") & text.rlike(r"^\s*[-–—]*\s*[0-9]{1,4}\s*[-–—]*\s*$")


def repeat_text_key(text: Column) -> Column:
    """Lower-case words joined by spaces; empty if they have fewer than six letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    joined = F.array_join(words, " ")
    return F.when(F.length(F.array_join(words, "")) < 6, F.lit("")).otherwise(joined)


def exact_page_digits(text: Column) -> Column:
    compact = F.regexp_replace(text, r"\s+", "")
    return F.when(compact.rlike("^[0-9]{1,3}$"), compact.cast("int"))


def heading_style(text: Column) -> Column:
    """A short line in capitals, or an enumerated one whose words are mostly capitalised."""
    compact = F.trim(F.regexp_replace(text, r"\s+", " "))
    tokens = F.regexp_extract_all(compact, F.lit("([A-Za-z][A-Za-z'`-]+)"), F.lit(1))
    upper = F.size(F.filter(tokens, lambda w: w.rlike("^[A-Z]")))
    enumerated = is_shape("heading_enumerator", compact) & ~compact.endswith(".") & (F.size(tokens) > 0) & (upper / F.size(tokens) >= 0.6)
    return (compact != "") & (F.octet_length(compact) <= 90) & ~is_shape("footnote_marker_line", compact) & (all_caps(compact) | enumerated)


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral by the subtraction rule; null if another character occurs."""
    values = F.create_map(*[F.lit(x) for pair in ROMAN_VALUES.items() for x in pair])
    numbers = F.transform(F.split(F.reverse(F.upper(text)), ""), lambda c: F.element_at(values, c))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prior"))

    def step(acc: Column, v: Column) -> Column:
        less = v < acc["prior"]
        return F.struct(F.when(less, acc["total"] - v).otherwise(acc["total"] + v).alias("total"), F.when(less, acc["prior"]).otherwise(v).alias("prior"))

    return F.when(F.upper(text).rlike("^[IVXLCDM]+$"), F.aggregate(numbers, start, step, lambda acc: acc["total"]))


def schedule_ordinal(text: Column) -> Column:
    """Arabic, Roman I to IX or a word FIRST to NINTH as a number."""
    from lexweave.functions.patterns import ROMAN_SCHEDULES, WORD_SCHEDULES

    word = F.upper(F.regexp_replace(F.trim(text), r"\.+$", ""))
    names = {n: i + 1 for i, n in enumerate(ROMAN_SCHEDULES)} | {n: i + 1 for i, n in enumerate(WORD_SCHEDULES)}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(word.rlike("^[0-9]{1,9}$") & (word.cast("int") >= 1), word.cast("int")).otherwise(F.element_at(table, word))
