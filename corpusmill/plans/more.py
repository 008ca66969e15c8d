"""Personal data, pages, search, language model counts, conversations and engine extras."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import text as X
from corpusmill.functions.sql import D
from corpusmill.operators import lexical, ngrams
from corpusmill.registry import query
from corpusmill.session import _shared_folder, broadcast_if_small, store, table

#: Patterns common to Java and RE2.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
PHONE = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


def _find_sql(pattern: str) -> str:
    return f"SELECT doc_id, ent, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS ent FROM documents) GROUP BY doc_id, ent"


def _find(spark, sf_dir, pattern):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("ent"))
    return found.groupBy("doc_id", "ent").agg(F.count(F.lit(1)).alias("n"))


@query(_find_sql(EMAIL))
def pii_email(spark, sf_dir):
    return _find(spark, sf_dir, EMAIL)


@query(_find_sql(IPV4))
def pii_ipv4(spark, sf_dir):
    return _find(spark, sf_dir, IPV4)


@query(_find_sql(PHONE))
def pii_phone(spark, sf_dir):
    return _find(spark, sf_dir, PHONE)


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g'), '{IPV4}', '[IP]', 'g'), '{PHONE}', '[PHONE]', 'g')) AS digest FROM documents")
def pii_redact(spark, sf_dir):
    text = F.col("text")
    for pattern, mark in ((EMAIL, "[EMAIL]"), (IPV4, "[IP]"), (PHONE, "[PHONE]")):
        text = F.regexp_replace(text, pattern, mark)
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(text.cast("binary")).alias("digest"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS value FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("value"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))::BIGINT AS links, coalesce(list_extract(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1), '') AS first_link FROM pages")
def html_links(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.size(found).cast("long").alias("links"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first_link"))


#: Hosts that a caller supports, and labels of hosts of two classes: parameters.
SUPPORTED, ADULT_HOSTS, GORE_HOSTS = ("example.com", "example.org"), ("adult-x", "casino-win"), ("spam-farm",)


@query(f"""SELECT page_id, host, len(p)::BIGINT AS labels, (CASE WHEN len(p) >= 2 AND (p[2] IN {SUPPORTED} OR p[-2] || '.' || p[-1] IN {SUPPORTED}) THEN 1 ELSE 0 END)::BIGINT AS supported,
(CASE WHEN len(p) < 2 THEN -1 WHEN len(list_intersect(p, {list(ADULT_HOSTS)})) > 0 OR contains(host, 'porn') THEN 1 WHEN len(list_intersect(p, {list(GORE_HOSTS)})) > 0 THEN 2 ELSE 0 END)::BIGINT AS flagged
FROM (SELECT *, string_split(host, '.') AS p FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages))""")
def url_flags(spark, sf_dir):
    """Supported sites by their second or last two labels; -1 no address, 1 and 2 the classes of hosts, 0 none."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rows = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", host.alias("host")).withColumn("p", F.split("host", r"\."))
    last = F.array_join(F.slice("p", -2, 2), ".")
    supported = F.when((F.size("p") >= 2) & (last.isin(*SUPPORTED) | F.get("p", F.lit(1)).isin(*SUPPORTED)), 1).otherwise(0)
    adult, gore = (F.arrays_overlap("p", F.array(*map(F.lit, hosts))) for hosts in (ADULT_HOSTS, GORE_HOSTS))
    flagged = F.when(F.size("p") < 2, -1).when(adult | F.contains("host", F.lit("porn")), 1).when(gore, 2).otherwise(0)
    return rows.select("page_id", "host", F.size("p").cast("long").alias("labels"), supported.cast("long").alias("supported"), flagged.cast("long").alias("flagged"))


@query("SELECT label, i::BIGINT AS dim, round(avg(embedding[i + 1]::DOUBLE), 4) AS value FROM embeddings, range(64) t(i) GROUP BY label, i")
def centroids(spark, sf_dir):
    dims = table(spark, sf_dir, "embeddings", "label", "embedding").select("label", F.posexplode("embedding").alias("dim", "v"))
    return dims.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 4).alias("value"))


BM25 = f"""WITH t AS (SELECT doc_id, lower(unnest(w)) AS term FROM {D}), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id), st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS al FROM dl),
q AS (SELECT doc_id AS query_id, term FROM tf WHERE doc_id % 100 = 0), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
s AS (SELECT query_id, d.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score
FROM q JOIN tf d ON d.term = q.term JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = d.doc_id, st WHERE query_id <> d.doc_id GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id)::INT AS rank, round(score, 4) AS score FROM s) WHERE rank <= 10"""


def _asked(docs):
    """The stated query set: every document whose id is divisible by 100."""
    return docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


@query(BM25)
def bm25_topk(spark, sf_dir):
    """BM25 with k1 = 1.2 and b = 0.75: queries are the texts of ids divisible by 100, against all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lexical.bm25(docs, _asked(docs))


@query(BM25)
def indexed_search(spark, sf_dir):
    """The same from an index written to a folder and read again."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = f"{_shared_folder(spark)}/index-{uuid.uuid4().hex}"
    lexical.save_index(docs, path)
    return lexical.search_index(spark, path, _asked(docs))


def _ngram_sql(n: int, group: str = "") -> str:
    return f"SELECT {group}{n}::BIGINT AS n, g AS ngram FROM (SELECT {group}unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) AS g FROM {D})"


NGRAMS = f"SELECT n, ngram, count(*)::BIGINT AS cnt FROM ({' UNION ALL '.join(_ngram_sql(n) for n in (1, 2, 3, 4, 5))}) GROUP BY n, ngram HAVING count(*) >= 5"


@query(NGRAMS)
def ngram_model_counts(spark, sf_dir):
    """N-grams of one to five words met at least five times."""
    return ngrams.ngram_counts(table(spark, sf_dir, "documents", "text"))


@query(f"SELECT split_part(ngram, ' ', 1) AS first, min(n) AS shortest, max(n) AS longest FROM ({NGRAMS}) WHERE n >= 2 AND cnt >= 20 GROUP BY first")
def compound_lengths(spark, sf_dir):
    return ngrams.compound_lengths(ngrams.ngram_counts(table(spark, sf_dir, "documents", "text")))


@query()
def compound_tokenize(spark, sf_dir):
    """Texts with frequent n-grams joined, longest first (sequential rule, tested against brute force)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return ngrams.compound_tokenize(docs, store(ngrams.ngram_counts(docs, least=20), "compounds"))


@query(f"SELECT n, ngram, min(cnt) AS weight, count(*)::BIGINT AS langs FROM (SELECT lang, n, ngram, count(*)::BIGINT AS cnt FROM ({' UNION ALL '.join(_ngram_sql(n, 'lang, ') for n in (1, 2))}) GROUP BY lang, n, ngram HAVING count(*) >= 5) GROUP BY n, ngram")
def consolidated_weights(spark, sf_dir):
    """Lowest weight of each n-gram over the languages' counts."""
    counts = ngrams.ngram_counts(table(spark, sf_dir, "documents", "lang", "text"), most=2, group="lang")
    return counts.groupBy("n", "ngram").agg(F.min("cnt").alias("weight"), F.count(F.lit(1)).alias("langs"))


_TOKENS = f"SELECT term AS token, 1.0 / n AS weight, length(term) AS cluster FROM (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM {D}) GROUP BY term)"


@query(f"""WITH t AS (SELECT *, substr(token, 1, 1) <> lower(substr(token, 1, 1)) AS upper FROM ({_TOKENS}))
SELECT token, first_value(token) OVER (PARTITION BY cluster, upper ORDER BY weight, token) AS parent FROM t""")
def synonym_parents(spark, sf_dir):
    """Parents of tokens; here a token's length stands for its cluster, the reverse of its count for its weight."""
    words = table(spark, sf_dir, "documents", "text").select(F.explode(X.words(F.col("text"))).alias("token")).groupBy("token").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return ngrams.synonym_parents(words.withColumn("cluster", F.length("token")))


@query(f"SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS idx FROM (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM {D}) GROUP BY term HAVING count(*) >= 5)")
def vocabulary_index(spark, sf_dir):
    """Numbers of words by falling count: ranges of counts are numbered apart, so no task sorts all words."""
    words = table(spark, sf_dir, "documents", "text").select(F.explode(X.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    words = store(words.withColumn("part", F.floor(F.log2("n") * 8).cast("int")), "words")
    sizes = words.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # some hundred rows
    before = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "term")) - 1
    return words.join(F.broadcast(sizes), "part").select("term", (rank + F.col("before")).cast("long").alias("idx"))


@query(f"SELECT lang, term, rank, cnt FROM (SELECT lang, term, count(*)::BIGINT AS cnt, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term)::INT AS rank FROM (SELECT lang, lower(unnest(w)) AS term FROM {D}) WHERE length(term) <= 10 GROUP BY lang, term) WHERE rank <= 75")
def learn_stopwords(spark, sf_dir):
    """The 75 most frequent words of at most ten characters (the rule's own bound) in each language."""
    terms = table(spark, sf_dir, "documents", "lang", "text").select("lang", F.explode(X.words(F.lower("text"))).alias("term")).filter(F.length("term") <= 10)
    counts = terms.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cnt"), "term"))
    return counts.withColumn("rank", rank).filter("rank <= 75")


@query("""SELECT conv_id, turn, round((coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(length(text) + 1) OVER (PARTITION BY conv_id)), 6) AS share,
lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations""")
def position_share(spark, sf_dir):
    """Place of a turn in its conversation, and the roles beside it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length("text") + 1
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.round(before / F.sum(size).over(Window.partitionBy("conv_id")), 6)
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "turn", share.alias("share"), F.lag("role").over(order).alias("prev_role"), F.lead("role").over(order).alias("next_role"))


@query(f"""WITH t AS (SELECT source, lower(unnest(w)) AS term FROM {D}), tf AS (SELECT source, term, count(*)::DOUBLE AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT source)::DOUBLE AS n FROM documents),
r AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY round(tf * ln(n / df), 4) DESC, term) AS rank FROM tf JOIN df USING (term), n)
SELECT source, string_agg(term, ', ' ORDER BY rank) AS label FROM r WHERE rank <= 5 GROUP BY source""")
def tfidf_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "source", "text")
    tf = docs.select("source", F.explode(X.words(F.lower("text"))).alias("term")).groupBy("source", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = float(docs.agg(F.countDistinct("source")).first()[0])
    weighed = tf.join(df, "term").withColumn("weight", F.round(F.col("tf") * F.log(F.lit(n) / F.col("df")), 4))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "term"))
    top = weighed.withColumn("rank", rank).filter("rank <= 5")
    named = top.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("terms"))
    return named.select("source", F.array_join(F.transform("terms", lambda t: t["term"]), ", ").alias("label"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Tumbling hours (engine extra)."""
    events = table(spark, sf_dir, "events", "ts", "event_type", "value")
    made = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return made.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("SELECT r_name, n_name, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_customers(spark, sf_dir):
    """Grouping sets over the star schema (engine extra)."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(broadcast_if_small(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
