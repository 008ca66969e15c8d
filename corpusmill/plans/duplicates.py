"""Duplicates of documents and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import dedup
from corpusmill.operators.normalise import SENTENCE_ENDS
from corpusmill.functions.sql import D, replace_sql
from corpusmill.registry import query
from corpusmill.session import table

_GRAMS = f"SELECT doc_id, unnest(CASE WHEN len(w) > 3 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+2], ' ')) ELSE w END) AS g FROM {D}"
_SUMS = " | ".join(f"(CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN 1::UBIGINT << {b} ELSE 0::UBIGINT END)" for b in range(64))
_CODES = f"""codes AS (SELECT d.doc_id, coalesce(c, 0::UBIGINT) AS code FROM documents d LEFT JOIN (SELECT doc_id, {_SUMS} AS c FROM
(SELECT doc_id, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM ({_GRAMS})) GROUP BY doc_id) USING (doc_id))"""
_HEX = "lower(lpad(to_hex({}), 16, '0'))"
_PAIRS = "pairs AS (SELECT a.code AS a, b.code AS b, bit_count(xor(a.code, b.code))::BIGINT AS dist FROM (SELECT DISTINCT code FROM codes) a JOIN (SELECT DISTINCT code FROM codes) b ON a.code <> b.code WHERE bit_count(xor(a.code, b.code)) <= 3)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_dup FROM documents")
def exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(_docs(spark, sf_dir))


@query(f"WITH {_CODES} SELECT doc_id, {_HEX.format('code')} AS simhash FROM codes")
def simhash(spark, sf_dir):
    return dedup.simhash(_docs(spark, sf_dir)).select("doc_id", dedup.hex16(F.col("simhash")).alias("simhash"))


@query(f"WITH {_CODES}, {_PAIRS} SELECT {_HEX.format('a')} AS a, {_HEX.format('b')} AS b, dist FROM pairs WHERE a < b")
def hamming_pairs(spark, sf_dir):
    """Pairs of distinct codes; the smaller code (as text) first."""
    pairs = dedup.hamming_pairs(dedup.simhash(_docs(spark, sf_dir)))
    a, b = dedup.hex16(F.col("a")), dedup.hex16(F.col("b"))
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "dist")


@query(f"""WITH RECURSIVE {_CODES}, {_PAIRS}, reach AS (SELECT DISTINCT code AS x, code AS y FROM codes UNION SELECT r.x, p.b FROM reach r JOIN pairs p ON r.y = p.a)
SELECT c.doc_id, m.cluster_id FROM codes c JOIN (SELECT r.x, min(d.doc_id) AS cluster_id FROM reach r JOIN codes d ON d.code = r.y GROUP BY r.x) m ON m.x = c.code""")
def dup_clusters(spark, sf_dir):
    return dedup.dup_clusters(_docs(spark, sf_dir))


_SHINGLES = r"""sh AS (SELECT doc_id, i - 1 AS pos, md5(regexp_replace(array_to_string(s[i:i+4], ' '), '\p{Nd}', '1', 'g')) AS shingle FROM
(SELECT doc_id, s, unnest(range(1, len(s) - 4)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]+[ \n]*'), lambda x: x <> '') AS s FROM documents) WHERE len(s) > 5))"""


@query(f"WITH {_SHINGLES} SELECT shingle, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS n FROM sh GROUP BY shingle")
def shingle_counts(spark, sf_dir):
    return dedup.shingle_counts(_docs(spark, sf_dir))


#: Common table expressions that end in ``status`` (doc_id, status).
STATUS = f"""{_SHINGLES}, again AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY shingle ORDER BY doc_id, pos) AS rn FROM sh) WHERE rn > 1),
whole AS (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(lower(text), '\\p{{Nd}}', '1', 'g') ORDER BY doc_id) > 1 AS seen FROM documents),
status AS (SELECT w.doc_id, (CASE WHEN a.doc_id IS NULL THEN 0 WHEN w.seen THEN 2 ELSE 1 END)::BIGINT AS status FROM whole w LEFT JOIN again a ON a.doc_id = w.doc_id)"""


@query(f"WITH {STATUS} SELECT doc_id, status FROM status")
def doc_dup_status(spark, sf_dir):
    return dedup.doc_dup_status(_docs(spark, sf_dir))


_CHUNKS = f"""norm AS (SELECT doc_id, {replace_sql("text", SENTENCE_ENDS)} AS t FROM documents), sents AS (SELECT doc_id, list_filter(list_transform(string_split(t, '  '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM norm),
ch AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN contains(x, ' ') OR length(x) <= 20 THEN [x] ELSE list_transform(range(0, length(x), 20), lambda i: substr(x, i::INT + 1, 20)) END)) AS c FROM sents),
runs AS (SELECT doc_id, i - 1 AS pos, md5(regexp_replace(array_to_string(c[i:i+4], ' '), '\\p{{Nd}}', '1', 'g')) AS h FROM (SELECT doc_id, c, unnest(range(1, len(c) - 4)) AS i FROM ch WHERE len(c) > 5)),
gone AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS rn FROM runs) WHERE rn > 1),
parts AS (SELECT doc_id, i - 1 AS k, c[i] AS part FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM ch)),
hit AS (SELECT p.doc_id, p.k, p.part, EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.pos BETWEEN p.k - 4 AND p.k) AS out FROM parts p),
kept AS (SELECT *, out AND coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY k), false) AS inner_hit FROM hit),
rest AS (SELECT doc_id, count(*) FILTER (out)::BIGINT AS n_removed, string_agg(CASE WHEN out THEN '*' ELSE part END, ' ' ORDER BY k) FILTER (NOT inner_hit) AS text, coalesce(string_agg(part, ' ' ORDER BY k) FILTER (NOT out), '') AS clean FROM kept GROUP BY doc_id)"""


@query(f"""WITH {_CHUNKS}, st AS (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(lower(clean), '\\p{{Nd}}', '1', 'g') ORDER BY doc_id) AS rn FROM rest WHERE n_removed > 0)
SELECT d.doc_id, (CASE WHEN st.rn IS NULL THEN 0 WHEN st.rn > 1 THEN 2 ELSE 1 END)::BIGINT AS status, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(coalesce(r.text, '')) AS digest
FROM documents d LEFT JOIN rest r ON r.doc_id = d.doc_id LEFT JOIN st ON st.doc_id = d.doc_id""")
def span_dedup(spark, sf_dir):
    """Runs of five sentences seen before are taken out of the texts."""
    made = dedup.span_dedup(_docs(spark, sf_dir))
    return made.select("doc_id", "status", "n_removed", F.md5(F.col("text").cast("binary")).alias("digest"))


_RUNS = """words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
runs AS (SELECT doc_id, i - 1 AS pos, md5(lower(array_to_string(w[i:i+49], ' '))) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
known AS (SELECT h, min((doc_id, pos)) AS low, min(doc_id) <> max(doc_id) AS shared FROM runs GROUP BY h HAVING count(*) > 1),
met AS (SELECT r.doc_id, r.pos, shared, (r.doc_id, r.pos) <> low AS gone FROM runs r JOIN known USING (h)),
hit AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS k, shared, gone FROM met),
counts AS (SELECT doc_id, count(DISTINCT k) FILTER (shared) AS n_shared, count(DISTINCT k) FILTER (gone) AS n_removed FROM hit GROUP BY doc_id),
left_over AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM (SELECT doc_id, i - 1 AS k, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)) w
WHERE NOT EXISTS (SELECT 1 FROM hit x WHERE x.gone AND x.doc_id = w.doc_id AND x.k = w.k) GROUP BY w.doc_id)"""


@query(f"""WITH {_RUNS} SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_shared, 0)::BIGINT AS n_shared, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(coalesce(l.text, '')) AS digest
FROM words w LEFT JOIN counts c ON c.doc_id = w.doc_id LEFT JOIN left_over l ON l.doc_id = w.doc_id""")
def passage_dedup(spark, sf_dir):
    """Passages of 50 words and more that stand in several documents, or twice in one."""
    made = dedup.passages(_docs(spark, sf_dir))
    return made.select("doc_id", "n_words", "n_shared", "n_removed", F.md5(F.col("text").cast("binary")).alias("digest"))
