"""Operator 8: benchmark decontamination with DataFrame and SQL functions only.

Texts become words (A-Z lower-cased; ASCII letters, digits and everything beyond ASCII). A window
is ``SIZE`` consecutive words of a benchmark item; an item of fewer words is one window. A document
word inside any occurrence of a window is hit.

1. The benchmark's distinct windows and short grams go to the driver, after their number is checked
   (``MOST_WINDOWS``), and from there to all tasks as a hash set inside the expression.
2. Each document is scanned once. A window of L words holds an aligned gram: with stride
   s = (L + 1) / 2, the gram of g = L - s + 1 words that starts at the window's first position
   divisible by s lies inside it. So only grams at every s-th word are hashed and looked up.
3. Only documents with such a gram are scanned window by window; windows are compared as whole
   strings, which verifies the hit. ``n_hit`` comes from folding the hits' spans, in the row.
4. ``matches`` explodes the hits of contaminated documents and joins them with the windows' items.

A benchmark beyond ``MOST_WINDOWS`` takes another way with the same results: windows of all
documents are exploded and joined by a shuffle on the window's hash and text.

Null or empty text: no words, not contaminated. Item without words: no window. Repeated rows (also
with the same id) are judged alike; ids may be null. Extra columns of documents are kept by
``clean`` and ``strip_spans`` and dropped by ``matches``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.expr import let
from corpusmill.llm.batches import fresh
from corpusmill.session import ascii_lower, spread

SIZE = 10
#: Windows that may be broadcast: at some 150 bytes each, 30 MB.
MOST_WINDOWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def to_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def runs(words: Column, size: int, step: int, make) -> Column:
    """``make`` of the slice at each ``step``-th position that leaves room for ``size`` words."""
    last = F.size(words) - (size - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: make(F.slice(words, i, F.lit(size)), i))


def windows_of(benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """window (its words joined by spaces), n (words), items (sorted distinct ids as text)."""
    items = benchmark.select(F.col(key).cast("string").alias("item"), F.explode(F.array(to_words(F.col(text)))).alias("words"))
    items = items.filter(F.size("words") > 0)
    long = items.filter(F.size("words") >= size).select(
        "item", F.explode(runs(F.col("words"), size, 1, lambda w, i: F.array_join(w, " "))).alias("window"), F.lit(size).alias("n")
    )
    short = items.filter(F.size("words") < size).select("item", F.array_join("words", " ").alias("window"), F.size("words").alias("n"))
    return long.unionByName(short).groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


@dataclass(frozen=True)
class Windows:
    """The benchmark's windows: ``table`` in Spark, and the sets that go to the tasks."""

    table: DataFrame
    by_length: dict[int, list[str]] | None
    grams: dict[int, list[int]] | None


def _stride(n: int) -> tuple[int, int]:
    step = (n + 1) // 2
    return step, n - step + 1


def prepare(benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = SIZE, most: int = MOST_WINDOWS) -> Windows:
    table = windows_of(benchmark, key, text, size)
    rows = table.select("n", "window").limit(most + 1).collect()
    if len(rows) > most:
        return Windows(table, None, None)
    by_length: dict[int, list[str]] = {}
    for n, window in rows:
        by_length.setdefault(n, []).append(window)
    grams: dict[int, list[int]] = {}
    for n in by_length:
        gram = _stride(n)[1]
        found = table.filter(F.col("n") == n).select(F.explode(F.array(F.split("window", " "))).alias("w"))
        found = found.select(F.explode(runs(F.col("w"), gram, 1, lambda w, i: F.xxhash64(w))).alias("h")).distinct()
        grams[n] = [r[0] for r in found.collect()]
    return Windows(table, by_length, grams)


_EMPTY = "CAST(array() AS array<struct<start:int,n:int,window:string>>)"


def _starts(size: int, step: int) -> str:
    return f"CASE WHEN size(words) >= {size} THEN sequence(1, size(words) - {size - 1}, {step}) ELSE CAST(array() AS array<int>) END"


def _spans(windows: Windows) -> str:
    """SQL text: spans (start, n, window) of the hits in ``words``, by start; empty without an aligned gram.

    Long lists of constants are written as text, which the parser reads faster than single columns;
    Spark keeps them as a hash set.
    """
    parts = []
    for n, texts in sorted(windows.by_length.items()):  # at most SIZE lengths
        step, gram = _stride(n)
        grams = ",".join(f"{h}L" if h > -(2**63) else "(-9223372036854775807L - 1L)" for h in windows.grams[n])
        near = f"exists({_starts(gram, step)}, i -> xxhash64(slice(words, i, {gram})) IN ({grams}))"
        every = f"transform({_starts(n, 1)}, i -> named_struct('start', i, 'n', {n}, 'window', array_join(slice(words, i, {n}), ' ')))"
        listed = ",".join(f"'{t}'" for t in texts)  # words hold no quote and no backslash
        parts.append(f"CASE WHEN {near} THEN filter({every}, s -> s.window IN ({listed})) ELSE {_EMPTY} END")
    if not parts:
        return _EMPTY
    return f"array_sort(concat({', '.join(parts)}))" if len(parts) > 1 else parts[0]


def _covered(spans: Column) -> Column:
    """Words inside the union of the spans (sorted by start)."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("next"))

    def step(s, x):
        end = x["start"] + x["n"]
        return F.struct((s["n"] + F.greatest(F.lit(0), end - F.greatest(x["start"], s["next"]))).alias("n"), F.greatest(s["next"], end).alias("next"))

    return F.aggregate(spans, state, step, lambda s: s["n"])


def _scan(docs: DataFrame, text: str, windows: Windows, name: str) -> DataFrame:
    """docs with a struct ``name``: n_words, spans, n_hit."""

    at = fresh(docs, f"{name}_words")
    # explode binds a result to a column of its own, so later steps don't compute it again
    rows = docs.select("*", F.explode(F.array(to_words(F.col(text)))).alias(at))
    spans = F.expr(f"explode(array(transform(array(`{at}`), words -> {_spans(windows)})[0]))")
    rows = rows.select("*", spans.alias(name))
    judged = F.struct(F.size(at).cast("long").alias("n_words"), F.col(name).alias("spans"), _covered(F.col(name)).alias("n_hit"))
    return rows.withColumn(name, judged).drop(at)


def _scan_shuffled(docs: DataFrame, text: str, windows: Windows, name: str) -> DataFrame:
    """The same for a benchmark too large to broadcast; rows are told apart by their content."""
    content = fresh(docs, f"{name}_content")
    docs = docs.withColumn(content, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    texts = docs.select(content, text).dropDuplicates([content]).select(content, F.explode(F.array(to_words(F.col(text)))).alias("words"))
    lengths = [r[0] for r in windows.table.select("n").distinct().collect()]  # at most SIZE values
    every = [runs(F.col("words"), n, 1, lambda w, i, n=n: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(w, " ").alias("window"))) for n in lengths]
    found = texts.select(content, F.explode(F.concat(*every) if every else F.array().cast("array<struct<start:int,n:int,window:string>>")).alias("s"))
    hits = found.join(windows.table.select(F.col("window").alias("w")), F.col("s.window") == F.col("w"), "left_semi")
    spans = hits.groupBy(content).agg(F.array_sort(F.collect_list("s")).alias("spans"))
    counted = texts.select(content, F.size("words").cast("long").alias("n_words"))
    judged = counted.join(spans, content, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,n:int,window:string>>")))
    judged = judged.select(content, F.struct("n_words", "spans", _covered(F.col("spans")).alias("n_hit")).alias(name))
    return docs.join(judged, content).drop(content)


def scan(docs: DataFrame, windows: Windows, text: str = "text", name: str = "scan") -> DataFrame:
    return (_scan if windows.by_length is not None else _scan_shuffled)(docs, text, windows, name)


def matches(docs: DataFrame, windows: Windows, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, items (sorted distinct ids as text), contaminated; one row for each document."""
    rows = scan(spread(docs.select(key, text)), windows, text)
    rows = rows.select(
        key, F.col("scan.n_words").alias("n_words"), F.col("scan.n_hit").alias("n_hit"),
        F.array_distinct(F.transform("scan.spans", lambda s: s["window"])).alias("found"),
    )
    # rows alike in key and windows are alike in items: they meet in one group, which keeps their number
    rows = rows.select(key, "n_words", "n_hit", F.sha2(F.array_join("found", "|"), 256).alias("same"), F.greatest(F.size("found"), F.lit(1)).alias("n"), F.explode_outer("found").alias("window"))
    known = windows.table.select("window", "items")
    if windows.by_length is not None:
        known = F.broadcast(known)
    groups = rows.join(known, "window", "left").groupBy(key, "n_words", "n_hit", "same", "n").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count(F.lit(1)) / F.col("n")).cast("int").alias("copies")
    )
    every = groups.select(key, "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"))
    return every.drop("_copy")


def clean(docs: DataFrame, windows: Windows, text: str = "text") -> DataFrame:
    """The documents without a hit, with all their columns."""
    name = fresh(docs, "scan")
    return scan(docs, windows, text, name).filter(F.col(f"{name}.n_hit") == 0).drop(name)


def strip_spans(docs: DataFrame, windows: Windows, text: str = "text", name: str = "stripped") -> DataFrame:
    """docs with ``name``: the words (normalised) outside all hits, joined by spaces."""
    at = fresh(docs, "scan")
    rows = scan(docs, windows, text, at)

    def outside(words):
        def hit(i):
            return F.exists(F.col(f"{at}.spans"), lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["n"]))

        return F.array_join(F.filter(words, lambda w, i: ~hit(i)), " ")

    return rows.withColumn(name, let(to_words(F.col(text)), outside)).drop(at)
