"""Scores and normalisations of single texts, as column expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.expr import let
from corpusmill.functions.lexicon import lang_group

SPACE = r"[ \t\n\r\f]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def ngrams(tokens: Column, n: int, drop_last: bool = True) -> Column:
    """Runs of ``n`` tokens joined by spaces; by default the last window is left out."""
    count = F.size(tokens) - n + (0 if drop_last else 1)
    starts = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def compound_ratio(text: Column) -> Column:
    """Sum of squared numbers of underscores per word, by words."""
    def total(w):
        square = F.aggregate(w, F.lit(0), lambda s, x: s + F.pow(F.length(x) - F.length(F.replace(x, F.lit("_"), F.lit(""))), F.lit(2)).cast("int"))
        return F.when(F.size(w) == 0, 0.0).otherwise(F.round(square / F.size(w), 6))

    return let(words(text), total)


#: Scripts in the order in which they are tried.
SCRIPTS = (
    ("zh", r"[\x{4E00}-\x{9FFF}]"), ("ko", r"[\x{AC00}-\x{D7A3}]"), ("ja", r"[\x{3040}-\x{30FF}]"),
    ("th", r"[\x{0E00}-\x{0E7F}]"), ("jv_tr", r"[\x{A980}-\x{A9DF}]"),
)


def script_detect(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, pattern in reversed(SCRIPTS):
        out = F.when(text.rlike(pattern), F.lit(code)).otherwise(out)
    return out


def emoji_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]", "")


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}", "1")


def lang_rules(first: str, score: str, second: str, stop: dict[str, str], script: str) -> tuple[Column, Column]:
    """(lang_id, score) from two opinions, stop-word shares by language (columns ``stop``) and the script.

    ``first`` with ``score`` is one model's label, ``second`` the other's. A score is raised by half
    if the labels differ but are of one group, or if it lies between .3 and .5 and is; then between .3 and .5 if the label's stop words fill
    more than .2 of the text. Below .5 the first language whose stop words do is taken with .3 + its share;
    still below .5, the script decides.
    """
    lang, other = F.col(first), F.col(second)
    near = F.lit(None).cast("boolean")
    for code in stop:
        near = F.when(other == code, lang.isin(*lang_group(code))).otherwise(near)
    near = F.coalesce(near, lang.eqNullSafe(other))
    own, some, share = (F.lit(None).cast(t) for t in ("double", "string", "double"))
    for code, column in reversed(stop.items()):
        own = F.when(lang == code, F.col(column)).otherwise(own)
        some, share = F.when(F.col(column) > 0.2, F.lit(code)).otherwise(some), F.when(F.col(column) > 0.2, F.col(column)).otherwise(share)

    def between(x: Column) -> Column:
        return (x > 0.3) & (x < 0.5)

    def rules(s1: Column) -> Column:
        return let(F.when(between(s1) & (own > 0.2), s1 * 1.5).otherwise(s1), last)

    def last(s2: Column) -> Column:
        low = s2 < 0.5
        best = F.when(low, F.coalesce(some, lang)).otherwise(lang)
        s3 = F.when(low, F.coalesce(share + 0.3, s2)).otherwise(s2)
        seen = (s3 < 0.5) & F.col(script).isNotNull()
        end = F.when(seen & (F.col(script) == best), s3 + 0.3).when(seen, 1 - s3).otherwise(s3)
        return F.struct(F.when(seen, F.col(script)).otherwise(best).alias("lang"), F.round(end, 6).alias("score"))

    unsure = ~lang.eqNullSafe(other) | between(F.col(score))
    judged = let(F.when(unsure & near, F.col(score) * 1.5).otherwise(F.col(score)), rules)
    return judged["lang"].alias("lang_id"), judged["score"].alias("score")
