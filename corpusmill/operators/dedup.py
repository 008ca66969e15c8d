"""Exact duplicates, SimHash codes, pairs and clusters of codes, repeated passages.

Null texts are equal to each other and differ from the empty one; as SimHash, sentences and words
they have nothing. Rows that repeat an id are one document to the operators that look for what stood
before: what they share with each other does not count as a repeat. Rows without an id come after all others.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import explode_rows, map_rows
from corpusmill.operators import text as X
from corpusmill.operators.graph import components
from corpusmill.operators.normalise import norm_sentences_py
from corpusmill.session import broadcast_if_small, join_back, measured_joins, store


def _firsts(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, h) with ``low``, the lowest id of their h; of any h a third of all rows may be."""
    rows = store(rows, "hashes")
    groups = store(rows.groupBy("h").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "groups")
    return join_back(rows, groups, "h")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, first_doc_id (lowest id of an equal text), is_dup. Only hashes are shuffled."""
    h = F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit("null").cast("binary"))
    rows = _firsts(docs.select("doc_id", h.alias("h")))
    return rows.select("doc_id", F.col("low").alias("first_doc_id"), (~F.col("doc_id").eqNullSafe(F.col("low"))).alias("is_dup"))


def windows_of(text: str | None, unit: str = "space", width: int = 3, ignore_marks: bool = False, lower: bool = False) -> list[str]:
    """Windows of ``width`` words (``space``), of parts between marks (``punctuation``) or of characters; the last one is left out.

    Too short a text: its words or parts, or by characters the text.
    """
    text = (text.lower() if lower else text) or "" if text else ""
    if ignore_marks:
        text = re.sub(r"[^\w\s]|_", "", text)
    if unit == "character":
        flat = " ".join(text.split())
        return [flat[i : i + width] for i in range(len(flat) - width)] or ([flat] if flat else [])
    parts = [p for p in (re.split(r"[^\w\s]+", text) if unit == "punctuation" else re.split(r"[ \t\n\r\f]+", text)) if p.strip()]
    return [" ".join(parts[i : i + width]) for i in range(len(parts) - width)] or parts


def simhash_code(grams: list[str]) -> int:
    """64-bit SimHash of ``grams``; without any, 0."""
    if not grams:
        return 0
    raw = b"".join(hashlib.md5(g.encode()).digest()[:8] for g in grams)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def simhash(docs: DataFrame, unit: str = "space", width: int = 3, ignore_marks: bool = False, lower: bool = False) -> DataFrame:
    """doc_id, simhash (signed 64-bit) of ``windows_of`` each text. One Arrow pass, no shuffle."""

    def code(text):
        value = simhash_code(windows_of(text, unit, width, ignore_marks, lower))
        return (value - ((value >> 63) << 64),)

    return map_rows(docs, ["text"], [("simhash", T.LongType())], lambda: code, keep=["doc_id"])


def hex16(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def hamming_pairs(codes: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, dist) of distinct codes within ``distance`` bits, a < b.

    Of ``blocks`` parts of a code at least blocks - distance are equal: each choice of so many is a
    key. With 6 parts a key has about 32 bits, so chance meetings stay rare in billions of codes.
    Copies share a code, so no group of copies is ever paired. The keys are merged, never broadcast:
    Spark takes the size of the exploded rows from the codes, a twentieth of it.
    """
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for kept in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << (ends[i + 1] - ends[i])) - 1) << ends[i] for i in kept)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.col("code").bitwiseAND(F.lit(mask).cast("long")), F.lit(len(keys))))
    dealt = codes.select(F.col("simhash").alias("code")).distinct().select("code", F.explode(F.array(*keys)).alias("key"))
    pairs = dealt.toDF("a", "key").hint("merge").join(dealt.toDF("b", "key"), "key").filter("a < b AND bit_count(a ^ b) <= %d" % distance)
    return pairs.select("a", "b", F.expr("bit_count(a ^ b)").cast("long").alias("dist")).distinct()


def dup_clusters(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, cluster_id: the lowest id among documents whose codes are linked, directly or in steps."""
    with measured_joins(docs.sparkSession):
        codes = store(simhash(docs), "simhash")
        labels = components(store(hamming_pairs(codes, distance), "pairs"))
        named = codes.join(labels.toDF("simhash", "comp"), "simhash", "left").select("doc_id", F.coalesce("comp", "simhash").alias("h"))
        return _firsts(named).select("doc_id", F.col("low").alias("cluster_id"))


_DIGIT = re.compile(r"\d")
_SENTENCE_END = re.compile(r"[.!?]+[ \n]*")

#: Text to the parts whose runs are compared.
Parts = Callable[[str], list[str]]


def sentence_parts(text: str) -> list[str]:
    """What stands between sentence marks."""
    return [s for s in _SENTENCE_END.split(text) if s]


def sentence_chunks(text: str, longest: int = 20) -> list[str]:
    """Sentences as ``norm_sentences`` marks them; a sentence without a space is cut in pieces of ``longest``."""
    out = []
    for sentence in norm_sentences_py(text).split("  "):
        sentence = sentence.strip()
        if " " not in sentence and len(sentence) > longest:
            out += [sentence[at : at + longest] for at in range(0, len(sentence), longest)]
        elif sentence:
            out.append(sentence)
    return out


def shingles(docs: DataFrame, size: int = 5, parts: Parts = sentence_parts, include_last: bool = False) -> DataFrame:
    """doc_id, pos, shingle: md5 of ``size`` consecutive parts, digits masked; the last run left out unless asked for."""

    def setup():
        def run(text):
            found = parts(text) if text else []
            count = len(found) - size + include_last
            return [(i, hashlib.md5(_DIGIT.sub("1", " ".join(found[i : i + size])).encode("utf-8", "surrogatepass")).digest()) for i in range(count)]

        return run

    return explode_rows(docs, "doc_id", ["text"], [("pos", T.IntegerType()), ("shingle", T.BinaryType())], setup)


def shingle_counts(docs: DataFrame, size: int = 5) -> DataFrame:
    """shingle (hex), docs, n. Repeats inside a document are counted first, so a hot shingle is one row a document."""
    inside = shingles(docs, size).groupBy("shingle", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    made = inside.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    return made.select(F.lower(F.hex("shingle")).alias("shingle"), "docs", "n")


#: A run's place, its 128-bit hash in two halves, and whether the document has it before.
_RUN = [("pos", T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType()), ("rep", T.BooleanType())]


def _marked(found: list[tuple[int, bytes]]) -> list[tuple[int, int, int, bool]]:
    seen, out = set(), []
    for pos, digest in found:
        out.append((pos, *struct.unpack("<qq", digest), digest in seen))
        seen.add(digest)
    return out


def _shingle_runs(docs: DataFrame, size: int, parts: Parts) -> DataFrame:
    """doc_id and the fields of ``_RUN`` of the runs that ``shingles`` has."""

    def setup():
        def run(text):
            found = parts(text) if text else []
            return _marked([(i, hashlib.md5(_DIGIT.sub("1", " ".join(found[i : i + size])).encode("utf-8", "surrogatepass")).digest()) for i in range(len(found) - size)])

        return run

    return store(explode_rows(docs, "doc_id", ["text"], _RUN, setup), "runs")


def _again(rows: DataFrame) -> DataFrame:
    """doc_id, pos, first, shared: the stored runs (doc_id and ``_RUN``) that stand elsewhere too, whether this is the first
    place, and whether another document has the run.

    First documents are found by sums of fixed width, which combine before the shuffle; a run that a third of
    all documents hold is joined back by broadcast.
    """
    found = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    met = join_back(rows, store(found.filter("n > 1"), "shared"), ["h1", "h2"])
    is_first = F.col("doc_id").eqNullSafe(F.col("low")) & ~F.col("rep")
    return met.select("doc_id", "pos", is_first.alias("first"), (~F.col("low").eqNullSafe(F.col("high"))).alias("shared"))


def doc_dup_status(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, status: 0 no passage seen before, 1 some, 2 the whole text (masked) seen before."""
    again = _again(_shingle_runs(docs, size, sentence_parts)).filter("NOT first").select("doc_id").distinct()
    whole = docs.select("doc_id", F.coalesce(F.md5(X.mask_digits(F.lower("text")).cast("binary")), F.lit("null")).alias("h"))
    seen = _firsts(whole).select("doc_id", F.coalesce(F.col("low") < F.col("doc_id"), F.lit(False)).alias("seen"))
    flagged = seen.join(again.select(F.col("doc_id").alias("id"), F.lit(True).alias("again")), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return flagged.select("doc_id", F.when(F.col("again").isNull(), 0).when(F.col("seen"), 2).otherwise(1).cast("long").alias("status"))


def span_dedup(docs: DataFrame, size: int = 5, mark: str = "*") -> DataFrame:
    """doc_id, status, n_removed (sentences), text: runs of ``size`` sentences seen before, here or in an earlier document, become ``mark``.

    Sentences are ``sentence_chunks``; the first occurrence by (doc_id, position) stays. Status 0: nothing
    seen before; 2: what is left was left of an earlier document with removed runs, too; else 1.
    """
    gone = _again(_shingle_runs(docs, size, sentence_chunks)).filter("NOT first").groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = broadcast_if_small(store(gone.withColumnRenamed("doc_id", "gone_id"), "gone"))  # texts stay where they are if the places are few
    met = docs.select("doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").drop("gone_id")

    def rewritten(text, gone):
        found = sentence_chunks(text) if text else []
        out, n, until, at = [], 0, 0, 0
        for i, chunk in enumerate(found):
            while gone and at < len(gone) and gone[at] <= i:
                until, at = max(until, gone[at] + size), at + 1
            if i < until:
                n += 1
                if not out or out[-1] is not mark:
                    out.append(mark)
            else:
                out.append(chunk)
        return n, out

    def rest(text, gone):
        n, out = rewritten(text, gone)
        left = " ".join(c for c in out if c is not mark)
        return (hashlib.md5(_DIGIT.sub("1", left.lower()).encode("utf-8", "surrogatepass")).hexdigest() if n else None,)

    def whole(text, gone):
        n, out = rewritten(text, gone)
        return n, " ".join(out)

    rests = map_rows(met.filter("gone IS NOT NULL"), ["text", "gone"], [("h", T.StringType())], lambda: rest, keep=["doc_id"]).filter("h IS NOT NULL")
    cut = _firsts(rests).select(F.col("doc_id").alias("id"), F.when(F.col("low") < F.col("doc_id"), 2).otherwise(1).alias("status")).distinct()
    made = map_rows(met, ["text", "gone"], [("n_removed", T.LongType()), ("left", T.StringType())], lambda: whole, keep=["doc_id"])
    out = made.join(broadcast_if_small(store(cut, "cut")), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", F.coalesce("status", F.lit(0)).cast("long").alias("status"), "n_removed", F.col("left").alias("text"))


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: str | None) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words), np.uint64)


def _run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = total * _MULTIPLIER + words[i : len(words) - size + 1 + i]
    return _mix(total)


def anchors(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): of the half runs inside each run of ``size`` words the one with the lowest hash.

    Two runs of ``size`` equal words choose the same place, so a shared passage always shares an
    anchor, while only some two of ``size`` / 2 words are one.
    """
    half = size // 2
    grams = _run_hashes(words, half)
    span = size - half + 1
    if len(grams) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    at = np.unique(np.arange(len(view)) + view.argmin(axis=1))
    return at, grams[at]


def passages(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_shared, n_removed, text: words inside runs of ``size`` words that another document has as well.

    Words are lower case, without white space, however sentences fall. ``n_shared`` counts all such
    words, ``n_removed`` those in runs that stand earlier, by (doc_id, position), in this document or another; ``text`` is what is left, joined by
    spaces. Only anchors, about two for ``size`` / 2 words, are shuffled for all documents; full runs
    are compared only around anchors that documents share. Runs are compared by 128-bit hashes.
    """
    half = size // 2

    def anchor_rows():
        def run(text):
            at, grams = anchors(_word_hashes(text), size)
            seen, out = set(), []
            for pos, gram in zip(at.tolist(), grams.view(np.int64).tolist(), strict=True):
                out.append((pos, gram, 0, gram in seen))
                seen.add(gram)
            return out

        return run

    marks = store(explode_rows(docs, "doc_id", ["text"], _RUN, anchor_rows), "anchors")
    near = _again(marks).groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("near")).withColumnRenamed("doc_id", "near_id")
    near = broadcast_if_small(store(near, "near"))
    some = docs.select("doc_id", "text").join(near, F.col("doc_id").eqNullSafe(F.col("near_id")))

    def run_rows():
        def run(text, near):
            words = (text or "").lower().split()
            starts = sorted({s for p in near for s in range(max(0, p - (size - half)), min(p, len(words) - size) + 1)})
            return _marked([(s, hashlib.md5(" ".join(words[s : s + size]).encode("utf-8", "surrogatepass")).digest()) for s in starts])

        return run

    runs = store(explode_rows(some, "doc_id", ["text", "near"], _RUN, run_rows), "runs")
    found = _again(runs).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("shared"), F.col("pos")))).alias("shared"), F.sort_array(F.collect_set(F.when(~F.col("first"), F.col("pos")))).alias("gone")
    ).withColumnRenamed("doc_id", "found_id")
    met = docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")

    def covered(starts, n):
        hit = np.zeros(n + 1, np.int64)
        for s in starts or ():
            hit[s] += 1
            hit[s + size] -= 1
        return np.cumsum(hit)[:n] > 0

    def rewrite(text, shared, gone):
        words = text.split() if text else []
        if not shared and not gone:
            return len(words), 0, 0, " ".join(words)
        out = covered(gone, len(words))
        return len(words), int(covered(shared, len(words)).sum()), int(out.sum()), " ".join(w for w, cut in zip(words, out, strict=True) if not cut)

    fields = [("n_words", T.LongType()), ("n_shared", T.LongType()), ("n_removed", T.LongType()), ("left", T.StringType())]
    return map_rows(met, ["text", "shared", "gone"], fields, lambda: rewrite, keep=["doc_id"]).withColumnRenamed("left", "text")
