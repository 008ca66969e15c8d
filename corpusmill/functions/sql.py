"""Parts of the SQL that gives a query's rows."""

from __future__ import annotations

from collections.abc import Iterable

from corpusmill.functions.lexicon import CJK_LANGS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replace_sql(text: str, pairs: Iterable[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    return text


def listed(terms: Iterable[str]) -> str:
    return "(" + ",".join(map(quoted, terms)) + ")"


WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')"
CJK = listed(CJK_LANGS)
#: documents with their words w, and the parts p that n-grams are made of.
D = f"(SELECT *, {WORDS} AS w, CASE WHEN lang IN {CJK} THEN string_split(text, '') ELSE {WORDS} END AS p FROM documents)"
