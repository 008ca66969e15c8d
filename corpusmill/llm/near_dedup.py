"""Operator 4: near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set holds the hashes of its distinct shingles of ``size`` words (``WORDS`` unless told). Documents with equal sets
form a class, which is compared once. A class is named by a 64-bit hash of its set; if documents of one name differ
in signature or size (at ten thousand million documents a few do), a second hash tells them apart. A class's signature has ``POSITIONS`` symbols of 16 bits (the
low bits of so many MinHash values); two classes' distance is the number of positions that differ.

Multi-index: the positions fall into ``CHUNKS`` chunks. Two signatures at a distance below
2 x CHUNKS have, by pigeonhole, a chunk with at most one error. For each chunk every place of that
error is enumerated: the key is the chunk without one position. So every pair within distance
``GUARANTEED`` shares a key. For a Jaccard similarity of 0.8 the distance has mean 16 and standard
deviation 3.6, so a pair on the very threshold is missed with a chance of about 4 in 100,000, one at
0.85 with about 1 in 100 million. Pairs that share a key are screened by distance, then confirmed on
their full sets (100 x intersection >= 80 x union).

No group is expanded into all its pairs. First the members of each key are compared with one of them,
the one that shares keys with most others; confirmed links join classes into components. What is left are keys whose
members are still in different components, most of them around large groups of near copies that
have drifted apart. Their classes go through a prefix filter, which is exact: with shingles in one
order, rarest first, two sets of that similarity share one of the first n - ceil(0.8 n) + 1. Sets
that drifted apart fill these places with shingles of their own, so almost no pairs are left; those
of different components are confirmed, which settles every key.

Null text, or text without words: no shingles, linked with nothing, kept. Fewer than ``size`` words:
the whole sequence is the one shingle. Rows that repeat an id are nodes of the same name: each is
judged by its own text. Null ids: never the smallest of a class that has others; a component
of null ids alone has a null component and its rows are kept. Copies of a text, of one id or of none,
cost one row each: a class's set is made from the rows of its lowest id with its first text only.
Very long texts are read whole; an empty table gives an empty result; extra columns are dropped
(``keep_one`` keeps all).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.batches import append
from corpusmill.session import broadcast_if_small, cut, fresh, join_back, measured_joins, spread, store

WORDS = 4
CHUNKS, CHUNK = 16, 5
POSITIONS = CHUNKS * CHUNK
GUARANTEED = 2 * CHUNKS - 1
MEMO = 100_000
#: Prefixes with one shingle from which on they are settled by a center first.
HOT_SHINGLE = 1_000
#: Rows of an Arrow batch with whole texts or sets: a pair of sets of 20,000 shingles takes 320 KB.
BATCH = 256

_random = np.random.RandomState(20240501)
_A = _random.randint(1, 2**62, POSITIONS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.randint(0, 2**62, POSITIONS, dtype=np.int64).astype(np.uint64)
_MIX = _random.randint(1, 2**62, WORDS + 2, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_KEYS = _random.randint(1, 2**62, (CHUNKS, CHUNK), dtype=np.int64).astype(np.uint64)
#: One multiplier for each word of a shingle.
_PLACES = np.concatenate([_MIX[:WORDS], _random.randint(1, 2**62, 12, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)])


class _Hashes(dict):
    """64-bit hash of each word seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[-2]
    x = (x ^ (x >> np.uint64(29))) * _MIX[-1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, hashes: _Hashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        total = (total ^ h[i : len(words) - width + 1 + i]) * _PLACES[i]
        total ^= total >> np.uint64(32)
    return np.unique(_scramble(total))


def signature(found: np.ndarray) -> np.ndarray:
    """POSITIONS symbols of 16 bits."""
    least = np.full(POSITIONS, np.uint64(2**64 - 1))
    for at in range(0, len(found), 512):
        part = found[at : at + 512]
        np.minimum(least, (part[:, None] * _A + _B).min(axis=0), out=least)
    return ((least >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16)


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """(n, CHUNKS x CHUNK) keys: each chunk without each of its positions."""
    parts = symbols.reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    made = np.empty(parts.shape, np.uint64)
    for out in range(CHUNK):
        key = np.zeros(parts.shape[:2], np.uint64)
        for i in range(CHUNK):
            if i != out:
                key = (key << np.uint64(16)) | parts[:, :, i]
        made[:, :, out] = _scramble(key ^ _KEYS[:, out])
    return made.reshape(len(parts), -1)


def _class_of(found: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(found.tobytes()) - 2**63 if len(found) else None


def _profiler(*parts: str, size: int):
    """A setup function: classes and, as ``parts`` ask, sizes, signatures and sets of texts."""
    if not 1 <= size <= len(_PLACES):
        raise ValueError(f"shingles have 1 to {len(_PLACES)} words")

    def setup():
        hashes = _Hashes()
        made = {
            "class": _class_of,
            "size": len,
            "signature": lambda found: signature(found).tobytes() if len(found) else None,
            "set": lambda found: found.tobytes(),
        }

        def run(texts):
            out = tuple([] for _ in parts)
            for text in texts:
                found = shingles(text, hashes, size)
                for values, part in zip(out, parts, strict=True):
                    values.append(made[part](found))
            return out

        return run

    return setup


def _expand(classes: DataFrame) -> DataFrame:
    """(key, node) for each key of each class."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
                made = keys_of(symbols.reshape(-1, POSITIONS)).view(np.int64)
                nodes = np.repeat(batch.column(0).to_numpy(), made.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), pa.array(nodes)], names=["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def _screen(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) near enough in signature distance and size."""
    half = classes.select("node", "n_shingles", "signature")
    sides = pairs.join(half.toDF("a", "na", "sa"), "a").join(half.toDF("b", "nb", "sb"), "b")
    sides = sides.filter((F.col("na") * 100 >= F.col("nb") * 80) & (F.col("nb") * 100 >= F.col("na") * 80))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, POSITIONS) for i in (2, 3))
                near = np.count_nonzero(a != b, axis=1) <= GUARANTEED
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near))

    return sides.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(nodes: DataFrame, classes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """node, n, set: the shingle sets of the classes ``nodes``, from the rows of one text of each class."""
    wanted = nodes.join(classes.select("node", "of"), "node").select("node", F.col("of.doc_id").alias("of"), F.col("of.text_hash").alias("of_hash"))
    wanted = cut(wanted)
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))
    picked = rows.join(broadcast_if_small(wanted), same).select("node", "text")
    sets = append(picked, ["text"], [("n", T.LongType()), ("set", T.BinaryType())], _profiler("size", "set", size=size))
    # rows that repeat an id and its text have the same set
    sets = sets.select("node", "n", "set")
    return store(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("set").alias("set")), "sets", BATCH)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    sets = sets.select("node", "set")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _prefixes(sets: DataFrame) -> DataFrame:
    """shingle, node, comp, n, place: the prefixes of sets (node, comp, n, set) where components meet."""

    def run(batches):
        for batch in batches:
            for node, comp, n, found in zip(*batch.columns, strict=True):
                found = np.frombuffer(found.as_buffer(), np.int64)
                same = [pa.array(np.full(len(found), x.as_py(), np.int64)) for x in (node, comp, n)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(found)], names=["node", "comp", "n", "shingle"])

    tokens = sets.select("node", "comp", "n", "set").mapInArrow(run, "node long, comp long, n long, shingle long")
    shared = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("df > 1")
    ranked = tokens.join(shared, "shingle")
    # shingles of one set alone come first in the order and match nothing: only their number counts
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")) + alone
    length = F.col("n") - F.expr("(4 * n + 4) div 5") + 1
    prefix = ranked.withColumn("place", place).filter(F.col("place") <= length).filter("low <> high")
    return store(prefix.select("shingle", "node", "comp", "n", "place"), "prefix", BATCH)


def _prefix_pairs(prefix: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of their prefixes."""
    pairs = prefix.toDF("shingle", "a", "ca", "na", "pa").join(prefix.toDF("shingle", "b", "cb", "nb", "pb"), "shingle")
    # at their first common shingle, two sets hold as many more in common as the shorter rest has places:
    # 100 x intersection >= 80 x union means 9 x intersection >= 4 x (sum of sizes)
    near = pairs.filter("a < b AND ca <> cb AND 9 * (1 + least(na - pa, nb - pb)) >= 4 * (na + nb)")
    return near.select("a", "b").distinct()


def _rest(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between the components of ``left`` (node, comp, n, set), enough to join them.

    A shingle in a great many prefixes (a template that short texts are made of) would meet all their
    pairs. Its sets are first compared with the largest of them, so that what is alike becomes one
    component; only pairs of components that remain apart are met.
    """
    prefix = _prefixes(left)
    hot = cut(prefix.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > HOT_SHINGLE).select("shingle"))
    if hot.isEmpty():
        return store(_confirm(_prefix_pairs(prefix), sets), "edges", BATCH)
    members = prefix.join(broadcast_if_small(hot), "shingle")
    centers = members.groupBy("shingle").agg(F.max(F.struct("n", "node")).getField("node").alias("center"))
    pairs = members.join(broadcast_if_small(cut(centers)), "shingle").filter("node <> center")
    pairs = pairs.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
    stars = store(_confirm(pairs, sets), "edges", BATCH)
    comps = prefix.select("node", "comp").distinct()
    joins = stars.join(comps.toDF("a", "ca"), "a").join(comps.toDF("b", "cb"), "b").filter("ca <> cb")
    names = components(joins.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("comp", "up")
    prefix = prefix.join(names, "comp", "left").withColumn("comp", F.coalesce("up", "comp")).select("shingle", "node", "comp", "n", "place")
    found = _confirm(_prefix_pairs(store(prefix, "prefix", BATCH)), sets)
    return store(stars.unionByName(found), "edges", BATCH)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b): comp is the smallest node it reaches.

    Each round gives a node the smallest label among its neighbours' and then its label's label, so
    the number of rounds grows with the logarithm of a chain's length. It ends when nothing changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"))
    for _ in range(rounds):
        near = both.join(labels.toDF("b", "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.toDF("node", "near"), "node").select("node", "comp", F.least("comp", "near").alias("to"))
        jump = step.join(labels.toDF("to", "jump"), "to").select("node", "comp", F.least("to", "jump").alias("to"))
        moved = cut(jump)
        labels = moved.select("node", F.col("to").alias("comp"))
        if moved.filter(F.col("comp") != F.col("to")).isEmpty():
            return labels
    return components_again(edges, labels, rounds)


def components_again(edges: DataFrame, labels: DataFrame, rounds: int) -> DataFrame:
    """Goes on from ``labels``: components of the graph whose nodes are the labels so far."""
    a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    upper = components(edges.join(a, "a").join(b, "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")), rounds)
    joined = labels.join(upper.toDF("comp", "up"), "comp", "left")
    return joined.select("node", F.coalesce("up", "comp").alias("comp"))


def _links(classes: DataFrame, rows: DataFrame, size: int) -> DataFrame | None:
    """(node, comp) of classes linked with another; None if there are none."""
    expanded = _expand(classes)
    shared = expanded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # keys that only one class has go no further
    held = store(expanded.join(shared, "key"), "keys")
    # a class that shares keys with many others is near the middle of its group
    weighed = held.join(held.groupBy("node").agg(F.sum("n").alias("weight")), "node")
    centers = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).getField("node").alias("center"))
    pairs = held.join(centers, "key").filter("node <> center")
    pairs = pairs.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
    sets = _sets(held.select("node").distinct(), classes, rows, size)
    edges = store(_confirm(_screen(pairs, classes), sets), "edges", BATCH)
    labels = None if edges.isEmpty() else components(edges)
    now = held.select("key", "node")
    now = now.withColumn("comp", F.col("node")) if labels is None else now.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    left = now.join(split, "key", "left_semi").select("node", "comp").distinct()
    more = _rest(store(sets.join(left, "node"), "left"), sets)
    return labels if more.isEmpty() else components(edges.union(more))


def _classes(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, classes): classes have node, low (lowest id), of (the row that stands for it), n_shingles, signature and n."""

    def group(profiles):
        some = profiles.filter(F.col("node").isNotNull())
        stands = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
        second = F.xxhash64("signature", "n_shingles")
        return cut(some.groupBy("node").agg(
            F.min("doc_id").alias("low"), stands.alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
            F.count(F.lit(1)).alias("n"), F.min(second).alias("s1"), F.max(second).alias("s2"),
        ))

    classes = group(profiles)
    doubtful = classes.filter("s1 <> s2").select(F.col("node").alias("twice"))
    if not doubtful.isEmpty():  # unequal sets of one name: a few among thousands of millions
        met = profiles.join(broadcast_if_small(doubtful), F.col("node") == F.col("twice"), "left")
        named = F.when(F.col("twice").isNull(), F.col("node")).otherwise(F.xxhash64("node", "signature", "n_shingles"))
        profiles = cut(met.withColumn("node", named).drop("twice"), "profiles", BATCH)
        classes = group(profiles)
    return profiles, classes


def _reach(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, component_id, n of each class."""
    if labels is None:
        return classes.select("node", F.col("low").alias("component_id"), "n")
    every = classes.join(labels, "node", "left").select("node", "low", "n", F.coalesce("comp", "node").alias("comp"))
    lows = every.groupBy("comp").agg(F.min("low").alias("component_id"))
    # of components only those with links are many to one; a hot one must not gather in a task
    linked = broadcast_if_small(cut(lows.join(labels.select("comp").distinct(), "comp")))
    return every.join(linked, "comp", "left").select("node", F.coalesce("component_id", "low").alias("component_id"), "n")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """key, n_shingles, component_id (smallest id reachable), kept, class_id."""
    fields = [("node", T.LongType()), ("n_shingles", T.LongType()), ("signature", T.BinaryType())]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    profiles = append(spread(rows), ["text"], fields, _profiler("class", "size", "signature", size=size)).drop("text")
    with measured_joins(docs.sparkSession):
        profiles, classes = _classes(cut(profiles, "profiles", BATCH))
        labels = _links(classes, rows, size)
        reach = cut(_reach(classes, labels))
    profiles = profiles.select("doc_id", "node", "n_shingles")
    none = profiles.filter(F.col("node").isNull()).withColumn("component_id", F.col("doc_id"))
    # documents without words meet nothing, and a class of a great many copies is joined by broadcast
    joined = join_back(profiles.filter(F.col("node").isNotNull()), reach, "node").unionByName(none)
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    out = joined.select("doc_id", "n_shingles", "component_id", same.alias("kept"), F.col("node").alias("class_id"))
    return out.withColumnRenamed("doc_id", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """One document of each component, with all its columns; documents without words all stay.

    Of rows that repeat the kept id with the same set, one stays.
    """
    judged = near_duplicates(docs, key, text, size).select(F.col(key).alias("id"), "class_id", "kept")
    with measured_joins(docs.sparkSession):
        judged = cut(judged)
    gone = judged.filter(~F.col("kept")).select("id", "class_id").distinct()
    repeated = judged.groupBy("id").count().filter("count > 1")
    if repeated.isEmpty():  # each id is judged once: the shorter list tells what stays
        stays, every = judged.agg(F.count_if("kept"), F.count(F.lit(1))).first()
        ids, how = (judged.filter("kept"), "left_semi") if 2 * stays < every else (gone, "left_anti")
        return docs.join(broadcast_if_small(ids.select("id")), docs[key].eqNullSafe(F.col("id")), how)
    node = fresh(docs, "class_id")
    rows = append(docs, [text], [(node, T.LongType())], _profiler("class", size=size))
    left = rows.join(broadcast_if_small(gone.toDF("id", "cls")), rows[key].eqNullSafe(F.col("id")) & (rows[node] == F.col("cls")), "left_anti")
    empty, full = left.filter(F.col(node).isNull()), left.filter(F.col(node).isNotNull())
    return full.dropDuplicates([key, node]).unionByName(empty).drop(node)
