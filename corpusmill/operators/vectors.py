"""Nearest neighbours of a stated query set, cluster trees and routed search in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import let
from corpusmill.operators.lexical import Best
from corpusmill.session import ship, store

BLOCK = 1024


def _unit(vectors: list) -> np.ndarray:
    m = np.asarray(vectors, np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1.0)


def _best(met: DataFrame, k: int, digits: int) -> DataFrame:
    """The ``k`` best rows of each query over all ``met`` blocks (q_ids, q_vectors, r_ids, r_vectors)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["r_ids"], np.int64)
                scores = np.round(_unit(row["q_vectors"]) @ _unit(row["r_vectors"]).T, digits) + 0.0
                for q, line in zip(row["q_ids"], scores, strict=True):
                    order = np.lexsort((ids, -line))
                    order = order[ids[order] != q][:k]
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(order), pa.int64()), pa.array(ids[order]), pa.array(line[order])], names=["vec_id", "nn_id", "score"])

    best = met.mapInArrow(run, "vec_id long, nn_id long, score double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "nn_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Bytes of query vectors that go to the tasks at once; each such group is one pass over the rows.
GROUP_BYTES = 16 * 2**20


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int = 5, digits: int = 4) -> DataFrame:
    """vec_id, nn_id, rank, score: the ``k`` rows most similar to each query, itself left out.

    Exact. Groups of queries (``GROUP_BYTES`` of vectors) go to the tasks, which meet their rows in
    blocks by one matrix product and pass on their ``k`` best for each query: the rows are not
    shuffled. Rows with a null vector or id are skipped; a zero vector scores 0; ties go to the lower id.
    """
    ship(rows.sparkSession)
    queries, rows = (d.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "embedding") for d in (queries, rows))
    queries = store(queries, "queries")
    count, wide = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    groups = 1 + count * (wide or 0) * 8 // GROUP_BYTES
    out = None
    for number in range(groups):
        asked = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == number).collect()
        shared = rows.sparkSession.sparkContext.broadcast(([r[0] for r in asked], _unit([r[1] for r in asked]) if asked else np.zeros((0, 1))))
        found = rows.mapInArrow(_nearest(shared, k, digits), "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    named = out.toDF("vec_id", "nn_id", "score")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "nn_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "nn_id", "score", "rank")


def _nearest(shared, k: int, digits: int):
    def run(batches):
        names, wanted = shared.value
        best, places = Best(len(names), k), {}
        for i, q in enumerate(names):
            places.setdefault(q, []).append(i)
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for at in range(0, len(ids) if names else 0, BLOCK):
                part = ids[at : at + BLOCK]
                scores = np.round(wanted @ _unit(vectors[at : at + BLOCK]).T, digits) + 0.0
                for column, i in enumerate(part.tolist()):
                    if i in places:
                        scores[places[i], column] = -np.inf
                best.add(part, scores)
        yield best.rows(names)

    return run


def mean_pooling(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors (array of arrays) whose mask (array of 0 and 1) is 1; none: zeros."""
    count = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)

    def mean(i):
        return F.aggregate(F.zip_with(tokens, mask, lambda t, m: F.get(t, i) * m), F.lit(0.0), lambda s, v: s + v) / F.greatest(count, F.lit(1e-9))

    return F.transform(F.sequence(F.lit(0), F.size(F.get(tokens, F.lit(0))) - 1), mean)


def softmax(x: Column, temperature: float = 1.0) -> Column:
    high = F.array_max(x)
    raised = F.transform(x, lambda v: F.exp((v - high) / temperature))
    return let(raised, lambda r: F.transform(r, lambda v: v / F.aggregate(r, F.lit(0.0), lambda s, y: s + y)))


def normalised(x: Column) -> Column:
    return let(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)), lambda n: F.transform(x, lambda v: v / F.greatest(n, F.lit(1e-12))))


def temperature_mix(x: Column, temperature: float | None = None) -> Column:
    """Mean of the softmax, the softmax at a temperature (without one the softmax again) and the unit vector."""
    second = softmax(x) if temperature is None else softmax(x, temperature)
    pairs = F.zip_with(softmax(x), second, lambda a, b: a + b)
    return F.transform(F.zip_with(pairs, normalised(x), lambda a, b: a + b), lambda v: v / 3)


def universal(rows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """vec_id, proto, value: the unit vector of cosines to the prototypes (proto, embedding), of which there are few."""
    met = rows.join(F.broadcast(prototypes.select("proto", F.col("embedding").alias("p")))).select("vec_id", "proto", _cosine(F.col("embedding"), F.col("p")).alias("c"))
    whole = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("vec_id")))
    return met.select("vec_id", "proto", (F.col("c") / F.greatest(whole, F.lit(1e-12))).alias("value"))


def merge_labels(clusters: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """vec_id, label: a cluster's new members get the label that most of its known members bear, if ``least`` do, else the lowest new id.

    clusters: vec_id, c; known: vec_id, label. Known rows keep their label; ties go to the lower label.
    """
    rows = clusters.join(known, "vec_id", "left")
    counts = rows.filter("label IS NOT NULL").groupBy("c", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    best = counts.groupBy("c").agg(F.max(F.struct("n", (-F.col("label")).alias("low"))).getField("low").alias("low")).select("c", (-F.col("low")).alias("old"))
    fresh = rows.filter("label IS NULL").groupBy("c").agg(F.min("vec_id").alias("first"))
    made = rows.join(best, "c", "left").join(fresh, "c", "left")
    return made.select("vec_id", F.coalesce("label", "old", "first").alias("label"))


def kmeans_batch(rows: DataFrame, k: int, known: DataFrame | None = None, least: int = 2, seed: int = 7) -> DataFrame:
    """vec_id, label: k-means clusters of the rows, named by ``merge_labels``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = store(rows.filter(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "rows").withColumn("features", array_to_vector("embedding"))
    found = KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("vec_id", F.col("prediction").cast("long").alias("c"))
    if known is None:
        known = rows.sparkSession.createDataFrame([], "vec_id long, label long")
    return merge_labels(store(found, "clusters"), known, least)


def parents(tree: DataFrame) -> DataFrame:
    """level, parent, children, top: the clusters of a tree (level, parent, child), highest level first."""
    top = tree.agg(F.max("level").alias("top_level"))
    made = tree.groupBy("level", "parent").agg(F.count(F.lit(1)).alias("children")).join(F.broadcast(top))
    return made.select("level", "parent", "children", (F.col("level") == F.col("top_level")).alias("top")).orderBy(F.desc("level"), "parent")


def roots(edges: DataFrame) -> DataFrame:
    """child, root, depth of every child in a forest (child, parent), by doubling the steps; a cycle ends with an error."""
    at = store(edges.select("child", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "roots")
    for _ in range(60):
        up = at.select(F.col("child").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        moved = store(at.join(up, "root", "left").select("child", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "roots")
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return at
    raise ValueError("the edges hold a cycle")


def lloyd(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` centres of ``points`` by k-means from far-apart beginnings; fewer where points repeat."""
    rng = np.random.default_rng(seed)
    centres = points[rng.integers(len(points), size=1)]
    near = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and near.sum() > 1e-12:
        centres = np.vstack([centres, points[rng.choice(len(points), p=near / near.sum())]])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each point, by blocks of points."""
    half = (centres**2).sum(axis=1) / 2
    parts = [np.argmin(half - points[at : at + 8192] @ centres.T, axis=1) for at in range(0, len(points), 8192)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def cluster_tree(rows: DataFrame, leaf: int = 25, most: int = 200, seed: int = 7, sample: int = 100_000) -> DataFrame:
    """level, parent, child, embedding: two levels of k-means, ``most`` clusters at the top and in each of them.

    Level 0 links leaf clusters (negative numbers of their own) to vec_ids; level 1 links top clusters to
    leaf clusters. The number of leaves is rows / ``leaf``, up to ``most`` x ``most``. Centres are fitted on the driver to
    the rows whose ids hash lowest, about ``sample`` of them; every row is then assigned in its task, without a shuffle. The
    centres that go to the tasks are bounded (40,000 at ``most`` 200). Rows with a null vector are left out.
    """
    ship(rows.sparkSession)
    schema = "level int, parent long, child long, embedding array<double>"
    nodes = store(rows.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("child"), F.col("embedding").cast("array<double>").alias("embedding")), "nodes")
    n = nodes.count()
    if n == 0:
        return rows.sparkSession.createDataFrame([], schema)
    order = F.xxhash64("child", F.lit(seed))
    some = nodes if n <= sample else nodes.filter(F.pmod(order, F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    taken = some.orderBy(order, "child").collect() or nodes.limit(1).collect()
    points = np.array([r[1] for r in taken])
    want = max(1, n // leaf)
    top = lloyd(points, min(most, max(1, round(want**0.5))), seed)
    own = nearest(points, top)
    parts = []
    for c in range(len(top)):
        members = points[own == c]
        share = min(most, max(1, round(want * len(members) / len(points))))
        parts.append(lloyd(members, share, seed + 1 + c) if len(members) else top[c : c + 1])
    first = np.cumsum([0, *map(len, parts)])
    shared = rows.sparkSession.sparkContext.broadcast((top, parts, first))

    def assign(batches):
        top, parts, first = shared.value
        for batch in batches:
            vectors = np.array(batch.column(1).to_pylist()) if batch.num_rows else np.empty((0, top.shape[1]))
            groups, leaves = nearest(vectors, top), np.zeros(len(vectors), np.int64)
            for c in np.unique(groups):
                leaves[groups == c] = first[c] + nearest(vectors[groups == c], parts[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(vectors), np.int32)), pa.array(-1 - leaves), batch.column(0), batch.column(1)], names=["level", "parent", "child", "embedding"])

    made = store(nodes.mapInArrow(assign, schema), "links")
    if len(top) == 1:
        return made
    leaves = int(first[-1])
    upper = [(1, -1 - leaves - c, -1 - int(first[c] + i), [float(v) for v in centre]) for c, part in enumerate(parts) for i, centre in enumerate(part)]
    met = made.select(F.col("parent").alias("child")).distinct()  # a leaf that no row chose is none
    above = rows.sparkSession.createDataFrame(upper, schema).join(F.broadcast(met), "child", "left_semi").select("level", "parent", "child", "embedding")
    return made.unionByName(above)


def _cosine(a, b):
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def _leaf_blocks(leaves: DataFrame) -> DataFrame:
    """parent, part, r_ids, r_vectors: the members of each leaf cluster in blocks of about BLOCK rows."""
    parts = leaves.groupBy("parent").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = leaves.join(F.broadcast(parts), "parent").withColumn("part", F.pmod(F.xxhash64("child"), F.col("parts")))
    return dealt.groupBy("parent", "part").agg(F.collect_list("child").alias("r_ids"), F.collect_list("embedding").alias("r_vectors"))


def _in_leaves(visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best members of the leaf clusters that each query visits. visits: vec_id, q, parent."""
    parts = blocks.select("parent", "part")
    asked = visits.join(F.broadcast(parts), "parent").withColumn("slice", F.pmod(F.col("vec_id"), F.lit(1 + visits.count() // BLOCK)))
    asked = asked.groupBy("parent", "part", "slice").agg(F.collect_list("vec_id").alias("q_ids"), F.collect_list("q").alias("q_vectors"))
    met = asked.join(blocks, ["parent", "part"]).select("q_ids", "q_vectors", "r_ids", "r_vectors")
    return _best(met, k, 4)


def _leaf_bounds(leaves: DataFrame) -> DataFrame:
    """parent, centre, low: the mean of each leaf cluster's members and their least cosine with it."""
    means = leaves.select("parent", F.posexplode("embedding").alias("i", "v")).groupBy("parent", "i").agg(F.avg("v").alias("v")).groupBy("parent")
    means = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centre"))
    lows = leaves.join(F.broadcast(means), "parent").groupBy("parent").agg(F.min(_cosine(F.col("centre"), F.col("embedding"))).alias("low"))
    return means.join(lows, "parent")


def tree_search(tree: DataFrame, queries: DataFrame, width: int = 5, k: int = 5) -> DataFrame:
    """vec_id, nn_id, rank, score: the ``k`` nearest rows, from the top level down by the ``width`` best nodes.

    Exact, as ``cosine_topk``. The route gives each query its first ``k`` rows. No member of a leaf cluster has
    an angle to the query below that of the cluster's centre less the widest of its members; clusters off the
    route whose bound reaches the k-th score are visited too. ``width`` decides the work, not the result.
    """
    tree = store(tree, "tree")
    top = tree.agg(F.max("level")).first()[0]
    if top is None:
        return queries.sparkSession.createDataFrame([], "vec_id long, nn_id long, score double, rank int")
    ship(tree.sparkSession)
    roots = tree.filter(F.col("level") == top).select("parent").distinct()
    held = queries.filter(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("q"))
    at = held.withColumn("parent", F.explode(F.lit([r[0] for r in roots.collect()])))  # at most ``most`` roots
    for level in range(top, 0, -1):
        down = tree.filter(F.col("level") == level).select("parent", "child", "embedding")
        met = at.join(down, "parent").select("vec_id", "q", F.col("child").alias("parent"), F.round(_cosine(F.col("q"), F.col("embedding")), 4).alias("score"))
        rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "parent"))
        at = store(met.withColumn("rank", rank).filter(F.col("rank") <= width).select("vec_id", "q", "parent"), "route")
    leaves = tree.filter("level = 0").select("parent", "child", "embedding")
    blocks = store(_leaf_blocks(leaves), "leaves", 16)
    near = store(_in_leaves(at, blocks, k), "near")
    # scores are rounded: one that is 1e-4 below may be equal
    reached = near.groupBy("vec_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score") - 1e-4).otherwise(-2.0).alias("least"))
    off = held.join(F.broadcast(_leaf_bounds(leaves))).join(at.select("vec_id", "parent"), ["vec_id", "parent"], "left_anti").join(reached, "vec_id", "left")

    def angle(cosine):
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))

    bound = F.cos(F.greatest(F.lit(0.0), angle(_cosine(F.col("q"), F.col("centre"))) - angle(F.col("low"))))
    more = store(off.filter(bound >= F.coalesce("least", F.lit(-2.0))).select("vec_id", "q", "parent"), "visits")
    both = near.drop("rank").unionByName(_in_leaves(more, blocks, k).drop("rank"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "nn_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)
