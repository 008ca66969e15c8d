"""Vector and hybrid search, cluster trees, streaming paths, set operations and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import embed, vectors
from corpusmill.plans.more import BM25, bm25_topk
from corpusmill.functions.sql import D
from corpusmill.registry import query
from corpusmill.session import table
from corpusmill.streaming import incremental

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 4)"
_TOP = f"""SELECT vec_id, nn_id, rank, score FROM (SELECT q.vec_id, r.vec_id AS nn_id, {_COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, r.vec_id)::INT AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding")


@query(_TOP)
def cosine_topk(spark, sf_dir):
    """Queries: every row whose id is divisible by 100, against all rows."""
    rows = _vectors(spark, sf_dir)
    return vectors.cosine_topk(rows.filter("vec_id % 100 = 0"), rows)


@query()
def cluster_tree(spark, sf_dir):
    return vectors.cluster_tree(_vectors(spark, sf_dir)).select("level", "parent", "child")


@query(_TOP)
def tree_search(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return vectors.tree_search(vectors.cluster_tree(rows), rows.filter("vec_id % 100 = 0"), width=50)


@query(f"""WITH b AS ({BM25}), v AS (SELECT vec_id AS query_id, nn_id AS doc_id, score FROM ({_TOP}))
SELECT query_id, doc_id, b.score AS bm25, v.score AS cosine FROM b FULL OUTER JOIN v USING (query_id, doc_id)""")
def hybrid_search(spark, sf_dir):
    """Hits by words and by vectors, outer-joined by query and row: queries are the ids divisible by 100 on both sides."""
    lexical_hits = bm25_topk(spark, sf_dir).select("query_id", "doc_id", F.col("score").alias("bm25"))
    rows = _vectors(spark, sf_dir)
    near = vectors.cosine_topk(rows.filter("vec_id % 100 = 0"), rows)
    dense = near.select(F.col("vec_id").alias("query_id"), F.col("nn_id").alias("doc_id"), F.col("score").alias("cosine"))
    return lexical_hits.join(dense, ["query_id", "doc_id"], "full_outer")


@query("""WITH t AS (SELECT vec_id, d, j, embedding[j * 8 + d + 1]::DOUBLE AS v FROM embeddings, range(8) r(d), range(8) s(j))
SELECT vec_id, d::INT AS dim, round(sum(v) / (1 + vec_id % 8), 6) AS value FROM t WHERE j < 1 + vec_id % 8 GROUP BY vec_id, d""")
def mean_pooling(spark, sf_dir):
    """Masked means; a vector's eight parts stand for tokens, of which the first few count."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.transform(F.slice("embedding", j * 8 + 1, F.lit(8)), lambda v: v.cast("double")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (j < 1 + F.col("vec_id") % 8).cast("double"))
    pooled = _vectors(spark, sf_dir).select("vec_id", F.posexplode(vectors.mean_pooling(tokens, mask)).alias("dim", "value"))
    return pooled.withColumn("value", F.round("value", 6))


@query("""WITH t AS (SELECT vec_id, i::INT AS dim, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) r(i)),
m AS (SELECT vec_id, sum(exp(x)) AS a, sum(exp(x / 0.1)) AS b, sqrt(sum(x * x)) AS n FROM t GROUP BY vec_id)
SELECT vec_id, dim, round((exp(x) / a + exp(x / 0.1) / b + x / n) / 3, 6) AS value FROM t JOIN m USING (vec_id)""")
def temperature_mix(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    made = _vectors(spark, sf_dir).select("vec_id", F.posexplode(vectors.temperature_mix(x, 0.1)).alias("dim", "value"))
    return made.withColumn("value", F.round("value", 6))


@query("""WITH c AS (SELECT label AS proto, i, avg(embedding[i + 1]::DOUBLE) AS p FROM embeddings, range(64) r(i) GROUP BY label, i),
m AS (SELECT vec_id, proto, sum(embedding[i + 1]::DOUBLE * p) / sqrt(sum(embedding[i + 1]::DOUBLE ** 2) * sum(p * p)) AS c FROM embeddings, c GROUP BY vec_id, proto)
SELECT vec_id, proto, round(c / sqrt(sum(c * c) OVER (PARTITION BY vec_id)), 4) AS value FROM m""")
def universal_embed(spark, sf_dir):
    """Vectors as unit vectors of cosines to prototypes, here the means of the labels."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    means = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    protos = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("embedding")).withColumnRenamed("label", "proto")
    return vectors.universal(rows, protos).withColumn("value", F.round("value", 4))


@query("""WITH r AS (SELECT vec_id, label AS c, CASE WHEN vec_id % 3 = 0 THEN vec_id % 7 END AS known FROM embeddings),
n AS (SELECT c, known, count(*) AS n FROM r WHERE known IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), b AS (SELECT c, first(known ORDER BY n DESC, known) AS old FROM n GROUP BY c),
f AS (SELECT c, min(vec_id) AS fresh FROM r WHERE known IS NULL GROUP BY c)
SELECT vec_id, coalesce(known, old, fresh)::BIGINT AS label FROM r LEFT JOIN b USING (c) LEFT JOIN f USING (c)""")
def merged_labels(spark, sf_dir):
    """Labels of a new clustering merged with known ones; the table's labels stand for the clusters."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label")
    clusters = rows.select("vec_id", F.col("label").cast("long").alias("c"))
    known = rows.filter("vec_id % 3 = 0").select("vec_id", (F.col("vec_id") % 7).alias("label"))
    return vectors.merge_labels(clusters, known)


@query()
def kmeans_batch(spark, sf_dir):
    """k-means clusters named after known labels (trained, so without SQL; the merge has its own query)."""
    rows = _vectors(spark, sf_dir)
    return vectors.kmeans_batch(rows, 10, rows.filter("vec_id % 3 = 0").select("vec_id", (F.col("vec_id") % 7).alias("label")))


@query()
def cluster_parents(spark, sf_dir):
    """The clusters of the tree, highest level first."""
    return vectors.parents(vectors.cluster_tree(_vectors(spark, sf_dir)))


_SIGNED = "SELECT doc_id, ('0x' || substr(md5(lower(x)), 1, 1))::INT AS dim, CASE WHEN ('0x' || substr(md5(lower(x)), 2, 1))::INT < 8 THEN 1 ELSE -1 END AS s FROM (SELECT doc_id, unnest(w) AS x FROM {D})"


@query(f"SELECT doc_id, dim, sum(s)::BIGINT AS value FROM ({_SIGNED.format(D=D)}) GROUP BY doc_id, dim")
def hash_embed(spark, sf_dir):
    """Hashing vectors of 16 dimensions, the embedder that is there without a model; any function of a text may be given."""
    made = embed.embed(table(spark, sf_dir, "documents", "doc_id", "text"), embed.hashing(16))
    return made.select("doc_id", F.posexplode("embedding").alias("dim", "v"), F.col("seen")).filter(F.array_contains("seen", F.col("dim"))).select("doc_id", "dim", F.col("v").cast("long").alias("value"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    """The hourly totals through the streaming engine."""
    made = incremental.window_totals(incremental.stream_table(spark, sf_dir, "events"))
    return incremental.run_available(made, "windows", "complete")


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*)::BIGINT AS n FROM (
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    made = incremental.sessions(incremental.stream_table(spark, sf_dir, "events"), late=None)
    return incremental.run_available(made, "sessions", "complete")


@query("SELECT DISTINCT md5(text) AS digest FROM documents")
def stream_dedup(spark, sf_dir):
    """The texts that the incremental duplicate filter lets pass, each once."""
    docs = incremental.stream_table(spark, sf_dir, "documents").select("doc_id", "text")
    return incremental.run_available(incremental.first_of_each_text(docs), "firsts").select(F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT lang, doc_id, round(round(mean - 2 * sd, 6), 3) AS cutoff, coalesce(score >= round(mean - 2 * sd, 6), true) AS keep FROM (
SELECT lang, doc_id, n_chars AS score, avg(n_chars) OVER f AS mean, stddev_samp(n_chars) OVER f AS sd FROM documents WINDOW f AS (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))""")
def stream_cutoffs(spark, sf_dir):
    """Moving cut-offs over text lengths with state; rows of a micro-batch are taken in order."""
    docs = incremental.stream_table(spark, sf_dir, "documents").select("lang", "doc_id", F.col("n_chars").cast("double").alias("score"))
    made = incremental.run_available(incremental.moving_cutoffs(docs), "cutoffs")
    return made.select("lang", "doc_id", F.round("cutoff", 3).alias("cutoff"), "keep")


@query("""SELECT event_id, CASE WHEN sd IS NULL THEN 1 WHEN value < mean - 0.5 * sd THEN 0 WHEN value > mean + 0.5 * sd THEN 2 ELSE 1 END::BIGINT AS level FROM (
SELECT event_id, value, round(avg(value) OVER f, 6) AS mean, round(stddev_samp(value) OVER f, 6) AS sd FROM events
WINDOW f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))""")
def stream_levels(spark, sf_dir):
    """Levels of values with state."""
    events = incremental.stream_table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return incremental.run_available(incremental.feature_levels(events, "event_type", "event_id", "value"), "levels").select("event_id", "level")


@query("SELECT lang, count(*)::BIGINT AS n, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS sd, median(n_chars)::DOUBLE AS mid FROM documents GROUP BY lang")
def length_stats(spark, sf_dir):
    size = F.col("n_chars")
    made = (F.count(size).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.round(F.avg(size), 4).alias("mean"), F.round(F.stddev_samp(size), 4).alias("sd"), F.median(size).alias("mid"))
    return table(spark, sf_dir, "documents", "lang", "n_chars").groupBy("lang").agg(*made)


_TERMS = f"SELECT DISTINCT lang, lower(unnest(w)) AS term FROM {D}"


@query(f"""WITH t AS ({_TERMS}) (SELECT 'both' AS side, term FROM (SELECT term FROM t WHERE lang = 'es' INTERSECT SELECT term FROM t WHERE lang = 'fr'))
UNION ALL (SELECT 'es' AS side, term FROM (SELECT term FROM t WHERE lang = 'es' EXCEPT SELECT term FROM t WHERE lang = 'fr'))""")
def shared_terms(spark, sf_dir):
    """Set operations on two languages' words."""
    from corpusmill.operators import text as X

    terms = table(spark, sf_dir, "documents", "lang", "text").select("lang", F.explode(X.words(F.lower("text"))).alias("term")).distinct()
    es, fr = (terms.filter(F.col("lang") == code).select("term") for code in ("es", "fr"))
    return es.intersect(fr).select(F.lit("both").alias("side"), "term").union(es.exceptAll(fr).select(F.lit("es").alias("side"), "term"))


_EDGES = """SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region"""


@query(f"""WITH RECURSIVE e AS ({_EDGES}), up AS (SELECT child, parent AS root, 1 AS depth FROM e UNION ALL SELECT u.child, e.parent, u.depth + 1 FROM up u JOIN e ON e.child = u.root)
SELECT child, max_by(root, depth) AS root, max(depth)::BIGINT AS depth FROM up GROUP BY child""")
def ontology_roots(spark, sf_dir):
    """Root and depth of every node of the tree customer -> nation -> region -> world."""
    def link(name, child, parent, c, p):
        return table(spark, sf_dir, name, child, *([parent] if p else [])).select(F.concat(F.lit(c), F.col(child)).alias("child"), (F.concat(F.lit(p), F.col(parent)) if p else F.lit("world")).alias("parent"))

    edges = link("customer", "c_custkey", "c_nationkey", "c", "n").unionByName(link("nation", "n_nationkey", "n_regionkey", "n", "r")).unionByName(link("region", "r_regionkey", "r_regionkey", "r", ""))
    return vectors.roots(edges)


LEVELS = """SELECT event_id, user_id, event_type, CASE WHEN sd IS NULL THEN 1 WHEN value < mean - 0.5 * sd THEN 0 WHEN value > mean + 0.5 * sd THEN 2 ELSE 1 END::BIGINT AS level FROM (
SELECT event_id, user_id, event_type, round(value, 6) AS value, round(avg((value * 1e6)::BIGINT) OVER f / 1e6, 6) AS mean, round(stddev_samp(value) OVER f, 6) AS sd FROM events
WINDOW f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""


def _levels(spark, sf_dir):
    from corpusmill.operators.windows import look_back

    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    millionths = F.round(F.col("value") * 1e6).cast("long")
    rows = look_back(events, "event_type", "event_id", 99, lambda f: {"mean": F.avg(millionths).over(f) / 1e6, "sd": F.stddev_samp("value").over(f)})
    rows = rows.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6), "value": F.round("value", 6)})
    level = F.when(F.col("sd").isNull(), 1).when(F.col("value") < F.col("mean") - 0.5 * F.col("sd"), 0).when(F.col("value") > F.col("mean") + 0.5 * F.col("sd"), 2).otherwise(1)
    return rows.select("event_id", "user_id", "event_type", level.cast("long").alias("level"))


@query(f"SELECT event_id, user_id, level FROM ({LEVELS})")
def feature_levels(spark, sf_dir):
    """Level 0, 1 or 2 of a value against the last 100 of its kind."""
    return _levels(spark, sf_dir).drop("event_type")


@query(f"""SELECT event_id, level, CASE WHEN level = 1 AND last_value(CASE WHEN level <> 1 THEN level END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 2
THEN 2 ELSE level END::BIGINT AS held FROM ({LEVELS})""")
def held_levels(spark, sf_dir):
    """The same with hysteresis: a high level holds until a low one is met."""
    from corpusmill.operators import windows

    return windows.held_levels(_levels(spark, sf_dir), "event_type", "event_id", "level").select("event_id", "level", "held")


@query("""WITH g AS (SELECT user_id, epoch(date_trunc('day', ts))::BIGINT // 86400 AS day FROM events GROUP BY ALL)
SELECT user_id, min(day) AS first_day, count(*)::BIGINT AS days FROM (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM g) GROUP BY user_id, run""")
def contiguous_runs(spark, sf_dir):
    """Runs of days on which a user was seen (gaps and islands)."""
    days = table(spark, sf_dir, "events", "user_id", "ts").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day")).distinct()
    run = F.col("day") - F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    return days.withColumn("run", run).groupBy("user_id", "run").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days")).drop("run")
