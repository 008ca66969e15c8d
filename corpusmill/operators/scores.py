"""Scores of whole texts in one Arrow pass: a text is split once, and all scores share its words.

Null text counts as empty. Words are runs without white space, as they stand unless a lexicon says
otherwise. In languages of ``CJK_LANGS`` lexicons and n-grams look at characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import map_rows
from corpusmill.functions.lexicon import CJK_LANGS, JUNK, STRIP
from corpusmill.session import broadcast_if_small, ship, store

_NO_JUNK = str.maketrans("", "", JUNK)


def greedy_hits(parts: Sequence[str], terms: Collection[str], longest: int, joint: str) -> tuple[int, int]:
    """(terms met, units): from the left the longest run of parts that is a term is one unit, else one part is."""
    hits = units = at = 0
    while at < len(parts):
        for end in range(min(len(parts), at + longest), at, -1):
            if joint.join(parts[at:end]) in terms:
                hits, at = hits + 1, end - 1
                break
        units, at = units + 1, at + 1
    return hits, units


class Lexicon:
    """Terms by language. ``shared``: a language whose terms count everywhere.

    ``none``: the share where a language has no term. ``strip``: marks taken off words first; words
    that are marks alone go. ``scale``: the factor for languages read by characters.
    """

    def __init__(self, lists: Mapping[str, Collection[str]], shared: str | None = None, none: float = 0.0, strip: str = "", scale: float = 1.5):
        common = frozenset(lists.get(shared, ())) if shared else frozenset()
        self.terms = {lang: frozenset(terms) | common for lang, terms in lists.items()}
        self.common, self.none, self.strip, self.scale = common, none, strip, scale

    def units(self, lang: str | None, words: list[str]) -> list[str]:
        """What terms are looked up in: lower-case words, or the characters of them."""
        if self.strip:
            words = [w for w in (x.strip(self.strip) for x in words) if w]
        return list("".join(words)) if lang in CJK_LANGS else words

    def hits(self, lang: str | None, words: list[str]) -> tuple[int, int]:
        """(terms met, units) of lower-case ``words``."""
        terms, by_char = self.terms.get(lang, self.common), lang in CJK_LANGS
        parts = self.units(lang, words)
        longest = max((len(t) if by_char else t.count(" ") + 1 for t in terms), default=1)
        if longest == 1:
            return sum(map(terms.__contains__, parts)), len(parts)
        return greedy_hits(parts, terms, longest, "" if by_char else " ")

    def share(self, lang: str | None, words: list[str]) -> float:
        if not self.terms.get(lang, self.common):
            return self.none
        hits, units = self.hits(lang, words)
        return hits / units * (self.scale if lang in CJK_LANGS else 1.0) if units else 0.0


def ngram_counts(parts: Sequence[str], n: int, drop_last: bool = True) -> Counter:
    """Counts of runs of ``n`` parts; by default the last run is left out."""
    parts = parts[:-1] if drop_last else parts
    return Counter(zip(*(parts[i:] for i in range(n)), strict=False))


def ngram_share(text: str, lang: str | None, words: list[str], n: int = 3) -> float:
    """Count of the most frequent n-gram by number of spaces + 1."""
    counts = ngram_counts(text if lang in CJK_LANGS else words, n)
    return max(counts.values()) / (text.count(" ") + 1) if counts else 0.0


def junk_share(text: str) -> float:
    """Share of ``JUNK`` characters; an empty text scores 1."""
    return 1 - len(text.translate(_NO_JUNK)) / len(text) if text else 1.0


#: Scores by name: (text, language, words, lower-case words) to a number.
Score = Callable[[str, str | None, list[str], list[str]], float]


def text_scores(docs: DataFrame, scores: Mapping[str, Score], lang: str = "lang", text: str = "text", keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` and one column for each of ``scores`` (rounded to 6 places): any function of a text will do."""
    wanted = dict(scores)

    def setup():
        def run(lang, value):
            value = value or ""
            words = value.split()
            lower = value.lower().split()
            return tuple(float(f(value, lang, words, lower)) for f in wanted.values())

        return run

    made = map_rows(docs, [lang, text], [(name, T.DoubleType()) for name in wanted], setup, keep)
    return made.withColumns({name: F.round(name, 6) for name in wanted})


def n_units(value: str, lang: str | None, words: list[str], lower: list[str]) -> float:
    """Words, or characters where a language is read by them."""
    return sum(map(len, words)) if lang in CJK_LANGS else len(words)


def ngram_score(n: int = 3) -> Score:
    return lambda value, lang, words, lower: ngram_share(value, lang, words, n)


def special_without_space(value: str, lang: str | None, words: list[str], lower: list[str]) -> float:
    """``junk_share`` of the text without its white space."""
    return junk_share("".join(words))


def lexicon_score(lexicon: Lexicon) -> Score:
    return lambda value, lang, words, lower: lexicon.share(lang, lower)


def banned_ratio(flagged: Lexicon, banned: Lexicon) -> Score:
    """Share of flagged units, times one more than a thousand times the share of banned ones."""

    def ratio(value, lang, words, lower):
        hits, units = flagged.hits(lang, lower)
        return hits / units * (1 + 1000 * banned.hits(lang, lower)[0] / units) if units else 0.0

    return ratio


def flagged_terms(docs: DataFrame, labels: DataFrame, least: int = 3, times: int = 100) -> DataFrame:
    """lang, term: words of toxic texts, met in ``least`` of a language's at least and ``times`` as often as in its others.

    All labelled rows count. Words are lower case, without marks at their ends.
    """
    known = labels.filter("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    # texts are not shuffled as long as the labels are small enough to go to them
    rows = docs.select("doc_id", "lang", "text").join(broadcast_if_small(known), "doc_id").select("lang", "toxic", "text")
    ship(rows.sparkSession)

    def run(batches):
        counts: dict[tuple, list[int]] = {}
        for batch in batches:
            for lang, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {w.strip(STRIP) for w in text.lower().split()} - {""} if text else ()
                for word in ("\n", *words):  # a line end is no word: it counts the texts
                    counts.setdefault((lang, word), [0, 0])[toxic] += 1
            if len(counts) > 300_000:
                yield flush(counts)
                counts = {}
        if counts:
            yield flush(counts)

    def flush(counts):
        columns = [[k[0] for k in counts], [k[1] for k in counts], [v[1] for v in counts.values()], [v[0] for v in counts.values()]]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "term", "t", "c"])

    counts = rows.mapInArrow(run, "lang string, term string, t long, c long").groupBy("lang", "term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = store(counts.filter(f"t >= {least} OR term = '\\n'"), "terms")
    totals = counts.filter("term = '\\n'").select(F.col("lang").alias("of"), F.col("t").alias("all_toxic"), F.col("c").alias("all_clean"))  # one row a language
    met = counts.filter("term <> '\\n'").join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("of")))
    return met.filter(f"t >= {least} AND t * all_clean > {times} * c * all_toxic").select("lang", "term")


def with_learned(lists: Mapping[str, Collection[str]], learned: DataFrame, most: int = 100_000) -> dict[str, set[str]]:
    """``lists`` and the terms of ``learned`` (lang, term); more than ``most`` are an error, as a lexicon goes to every task."""
    rows = learned.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms: ask for more or clearer evidence")
    out = {lang: set(terms) for lang, terms in lists.items()}
    for lang, term in rows:
        out.setdefault(lang, set()).add(term)
    return out


def special_char_score(text: Column) -> Column:
    """``junk_share`` as an expression; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    rest = F.length(text) - F.length(F.translate(text, JUNK, ""))
    return F.when(F.length(text) == 0, 1.0).otherwise(F.round(rest / F.length(text), 6))


def junk_ratio(text: Column) -> Column:
    """The same of the trimmed lower-case text; null where that is empty."""
    text = F.lower(F.btrim(text, F.lit(" \t\n\r\f")))
    return F.when(F.length(text) > 0, F.round((F.length(text) - F.length(F.translate(text, JUNK, ""))) / F.length(text), 6))
