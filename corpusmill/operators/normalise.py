"""Normal forms of texts, as column expressions. Null stays null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import map_rows

# Full-width and typographic marks and their plain forms.
PUNCT: dict[str, str] = {
    "，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "１": "1", "」": '"', "「": '"', "《": '"', "》": '"',
    "´": "'", "∶": ":", "：": ":", "？": "?", "！": "!", "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ", "～": "~", "’": "'",
    "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-",
}
_SINGLE = {k: v for k, v in PUNCT.items() if len(v) == 1}
_LONGER = {k: v for k, v in PUNCT.items() if len(v) > 1}
#: Control characters.
NON_PRINTING = r"[\x00-\x1F\x7F-\x9F]"
#: Marks and what stands behind them at a sentence's end, joined by the rule: plain marks need a space, full-width ones none.
SENTENCE_ENDS = [
    pair
    for closer in ("", '"', "”", "》")
    for pair in (*((f"{m}{closer} ", f"{m}{closer}  ") for m in "!?."), *((f"{m}{closer}", f"{m}{closer}  ") for m in "．。？"))
] + [("、", "、 "), ("’s", " 's"), ("`s", " 's"), ("'s", " 's")]
#: Marks that a line end left behind another mark, and what remains.
PSEUDO_ENDS = [("。. ", "。 "), (". .", "."), (".. ", ". "), (" . . ", ". "), ("?. ", "? "), ("!. ", "! "), (",. ", ", "), (".”. ", ".” "), ('.". ', '." ')]


def replace_all(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unicode_punct(text: Column, remove: bool = False) -> Column:
    """Marks of ``PUNCT`` in their plain forms, or taken out."""
    if remove:
        return F.translate(text, "".join(PUNCT), "")
    return replace_all(F.translate(text, "".join(_SINGLE), "".join(_SINGLE.values())), list(_LONGER.items()))


def non_printing(text: Column) -> Column:
    return F.regexp_replace(text, NON_PRINTING, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Words joined by one space."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def lm_normalize(text: Column, lower: bool = True, numbers: bool = True, punct: int = 1) -> Column:
    """Trimmed, lower case, digits as 0, marks plain (``punct`` 1) or taken out (2), no control characters."""
    text = strip(text)
    text = F.lower(text) if lower else text
    text = F.regexp_replace(text, r"\p{Nd}", "0") if numbers else text
    text = unicode_punct(text, remove=punct == 2) if punct else text
    return non_printing(text)


def strip_accents(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the letters of ``column`` without their marks (decomposed; no built-in function does that)."""
    import unicodedata

    def bare(text):
        if text is None or text.isascii():
            return (text,)
        return ("".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"),)

    others = [c for c in df.columns if c != column]
    made = map_rows(df, [column], [("stripped_text", T.StringType())], lambda: bare, keep=others)
    return made.withColumnRenamed("stripped_text", column).select(*df.columns)


#: (what, by what, whether a pattern) in order. Back references are written \1; the last rules depend on the language.
SPACING: list[tuple[str, str, bool]] = [
    ("\r", "", False), ("(", " (", False), (")", ") ", False), (" +", " ", True), (r"\) ([.!:?;,])", r")\1", True),
    ("( ", "(", False), (" )", ")", False), (r"(\d) %", r"\1%", True), (" :", ":", False), (" ;", ";", False), ("`", "'", False), ("''", ' " ', False),
    ("„", '"', False), ("“", '"', False), ("”", '"', False), ("–", "-", False), ("—", " - ", False), (" +", " ", True), ("´", "'", False),
    ("([a-z])[‘’]([a-z])", r"\1'\2", True), ("[‘‚’]", '"', True), ("''", '"', False), ("…", "...", False),
    (" « ", ' "', False), ("« ", '"', False), ("«", '"', False), (" » ", '" ', False), (" »", '"', False), ("»", '"', False),
    (" %", "%", False), (" :", ":", False), (" ?", "?", False), (" !", "!", False), (" ;", ";", False), (" +", " ", True), ("．", ". ", False),
]
SPACING_EN = [(r'"([,.]+)', r'\1"', True)]
SPACING_OTHER = [(',"', '",', False), (r'(\.+)"(\s*[^<])', r'"\1\2', True)]
#: Languages that leave quotes alone, and those with a decimal comma.
NO_QUOTE_RULE, COMMA = ("cs", "cz"), ("de", "es", "cz", "cs", "fr")


def _apply(text: Column, rules: Sequence[tuple[str, str, bool]]) -> Column:
    for old, new, pattern in rules:
        text = F.regexp_replace(text, old, new.replace("\\1", "$1").replace("\\2", "$2")) if pattern else F.replace(text, F.lit(old), F.lit(new))
    return text


def spacing_for_tok(text: Column, lang: Column) -> Column:
    """Spaces around brackets, quotes and marks as a tokenizer expects them; "1 2" is one number by the language's sign."""
    text = _apply(text, SPACING)
    text = F.when(lang == "en", _apply(text, SPACING_EN)).when(lang.isin(*NO_QUOTE_RULE), text).otherwise(_apply(text, SPACING_OTHER))
    return F.when(lang.isin(*COMMA), _apply(text, [(r"(\d) (\d)", r"\1,\2", True)])).otherwise(_apply(text, [(r"(\d) (\d)", r"\1.\2", True)]))


def norm_sentences(text: Column) -> Column:
    """Two spaces behind each sentence."""
    return replace_all(text, SENTENCE_ENDS)


def norm_sentences_py(text: str) -> str:
    for old, new in SENTENCE_ENDS:
        text = text.replace(old, new)
    return text


def clean_pseudo_punct(text: Column) -> Column:
    return collapse(replace_all(text, PSEUDO_ENDS))


#: Kinds of page elements whose content goes with their marks.
ELEMENTS = ("nav", "code", "meta", "form", "address", "table")
#: Marks of elements: begin, and end.
ELEMENT_MARKS = (r"###\w+###\d+###", r"###/[^#]+###|▁/[^#]+###")


def strip_elements(text: Column) -> Column:
    """Text without elements of ``ELEMENTS`` and without the marks of others; each becomes two spaces."""
    text = F.replace(collapse(text), F.lit("###/"), F.lit("▁/"))
    for kind in ELEMENTS:
        text = F.regexp_replace(text, rf"###{kind}###\d+###[^▁]+▁/{kind}###", "  ")
    for marks in ELEMENT_MARKS:
        text = F.regexp_replace(text, marks, "  ")
    return text


#: Patterns of dates, tried in order, and the form they get.
DATE_FORMS, DATE_OUT = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "MMMM d, yyyy", "d MMMM yyyy"), "MM/dd/yy"


def date_norm(text: Column) -> Column:
    """A date in one of ``DATE_FORMS`` as month/day/year; whole numbers and other texts are null."""
    return F.when(text.rlike(r"^\s*\d+\s*$"), None).otherwise(F.date_format(F.coalesce(*(F.try_to_date(text, f) for f in DATE_FORMS)), DATE_OUT))


def to_int(text: Column) -> Column:
    """A whole number of at most 18 digits, else null."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.trim(text).try_cast("bigint"))
