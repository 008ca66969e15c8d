"""Operator 3: language by cross-parsing entropy.

For each language a suffix automaton holds all substrings of the words of its labelled sample. A
text is parsed against each: the longest prefix of what is left that the automaton holds is one
phrase. With c phrases over n characters and N characters in the sample, c * log2(N) / n estimates
the cross entropy (Ziv and Merhav); the language with the lowest wins, ties go to the first by
name. Words (runs of letters, lower case, with a border mark on both sides) are parsed apart, so a
phrase never spans two words and a task can keep the phrase counts of words it has seen.

The sample is bounded: ``docs_per_lang`` documents with the lowest hash of their id, and of all words
of these whole texts the most frequent, as many as fit ``chars_per_lang`` characters. Samples end at the length of the
shortest, if that has ``least_chars``; log2(N) evens out the rest.

Letters are the characters of Unicode's category L. Null text or text without a letter: ``und`` with
score 0. No labelled row: every text is ``und``. Rows with a null label are not learned from. A text
without a word that fits any language better ties, and the first language by name is given. Words
may have any length (scripts that don't space words, texts of one word). An empty table gives an
empty result. Other columns are dropped; repeated rows stay.
"""

from __future__ import annotations

import math
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.batches import append, bounded_sample
from corpusmill.session import spread

UNDETERMINED = "und"
LETTERS = regex.compile(r"\p{L}+")
MEMO = 300_000
#: Characters of the longest word whose phrases are kept.
LONGEST_KEPT = 64


class SuffixAutomaton:
    """All substrings of the strings added, as a graph of states."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, target: int, char: str) -> int:
        """A copy of ``target`` for the substrings that ``state`` extends by ``char``."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(char) == target:
            self.next[state][char] = copy
            state = self.link[state]
        return copy

    def add(self, string: str) -> None:
        last = 0
        for char in string:
            target = self.next[last].get(char)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, target, char)
                continue
            new, state = self._state(self.length[last] + 1, {}, 0), last
            while state >= 0 and char not in self.next[state]:
                self.next[state][char] = new
                state = self.link[state]
            if state >= 0:
                target = self.next[state][char]
                ok = self.length[target] == self.length[state] + 1
                self.link[new] = target if ok else self._split(state, target, char)
            last = new

    def phrases(self, string: str) -> int:
        """Phrases of the greedy parse; a character never seen is a phrase."""
        edges, state, count, fresh = self.next, 0, 0, True
        for char in string:
            following = edges[state].get(char)
            if following is None:
                count += not fresh
                following = edges[0].get(char)
                if following is None:
                    count, state, fresh = count + 1, 0, True
                    continue
            state, fresh = following, False
        return count + (not fresh)


def words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Identifier:
    def __init__(self, sample: dict[str, list[str]]):
        self.langs = sorted(sample)
        self.automata, self.bits = [], []
        for lang in self.langs:
            automaton = SuffixAutomaton()
            for word in sample[lang]:
                automaton.add(f" {word} ")
            self.automata.append(automaton)
            self.bits.append(math.log2(2 + sum(len(w) + 2 for w in sample[lang])))
        self.memo: dict[str, tuple[float, ...]] = {}

    def word(self, word: str) -> tuple[float, ...]:
        cost = self.memo.get(word)
        if cost is None:
            marked = f" {word} "
            cost = tuple(a.phrases(marked) * b for a, b in zip(self.automata, self.bits, strict=True))
            if len(word) <= LONGEST_KEPT:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = cost
        return cost

    def text(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.langs:
            return UNDETERMINED, 0.0
        costs = [math.fsum(c) for c in zip(*map(self.word, found), strict=True)]
        least = min(costs)
        gaps = [min(500.0, (c - least) / math.log2(math.e)) for c in costs]
        return self.langs[costs.index(least)], 1 / sum(math.exp(-g) for g in gaps)


@lru_cache(maxsize=2)
def _identifier(key: tuple) -> Identifier:
    return Identifier({lang: list(ws) for lang, ws in key})


def learn(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    docs_per_lang: int = 300, chars_per_lang: int = 60_000, least_chars: int = 5_000, max_langs: int = 500,
) -> dict[str, list[str]]:
    """Sample words for each language, most frequent first; at most ``max_langs`` x ``chars_per_lang`` characters reach the driver."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = bounded_sample(rows.select("key", "lang").distinct(), "lang", "key", docs_per_lang).select("key", "lang")
    # the ids are at most docs_per_lang x languages
    picked = rows.join(F.broadcast(ids), ["key", "lang"]).select("lang", F.lower("text").alias("text"))
    found = picked.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = found.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
    sized = counts.withColumn("ends", F.sum(F.length("word") + 2).over(so_far)).filter(F.col("ends") <= chars_per_lang)
    sizes = {r[0]: r[1] for r in sized.groupBy("lang").agg(F.max("ends")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    most = min([chars_per_lang, *(size for size in sizes.values() if size >= least_chars)])
    sample: dict[str, list[str]] = {}
    for row in sized.filter(F.col("ends") <= most).orderBy("lang", "ends").select("lang", "word").collect():
        sample.setdefault(row[0], []).append(row[1])
    return sample


def language_id(docs: DataFrame, sample: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text's language (``lang_pred``) and ``score``, the share of the best parse in 2^-bits.

    What is broadcast is bounded by languages x ``chars_per_lang``.
    """
    frozen = tuple(sorted((lang, tuple(ws)) for lang, ws in sample.items()))
    shared = docs.sparkSession.sparkContext.broadcast(frozen)

    def setup():
        identifier = _identifier(shared.value)

        def run(texts):
            found = [identifier.text(t) for t in texts]
            return [x for x, _ in found], [s for _, s in found]

        return run

    rows = spread(docs.select(key, text))
    return append(rows, [text], [("lang_pred", T.StringType()), ("score", T.DoubleType())], setup).drop(text)


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n
