"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (
    decontaminate,
    html_extract,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    token_count,
    url_filter,
)
from corpusmill.session import table

#: A parameter: any SentencePiece file will do; set the environment's CORPUSMILL_VOCABULARY for another.
VOCABULARY = os.environ.get("CORPUSMILL_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = language_id.remainder("doc_id", 3) == 1
    found = language_id.language_id(docs, language_id.learn(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.rules(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = language_id.remainder("doc_id", 5) == 0
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels").filter(~held))
    return quality_classifier.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = decontaminate.prepare(table(spark, sf_dir, "benchmark"))
    found = decontaminate.matches(table(spark, sf_dir, "documents", "doc_id", "text"), windows)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages", "page_id", "url"), RULES, url_filter.train(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_counts, op2_mix_sources, op3_language_id, op4_near_dedup, op5_html_text,
            op6_quality_rules, op7_quality_classifier, op8_decontaminate, op9_license_scan, op10_url_filter,
        )
    }


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(separators: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{separators}'), lambda x: x <> '')"


#: Shingle sets, links by counts of common shingles, and what they reach.
_NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(r'[\x20\x09-\x0D]+')} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x),
low AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT low.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, low.doc_id = component_id AS kept FROM low LEFT JOIN n ON n.doc_id = low.doc_id"""

#: Windows of all lengths that items have, at every position.
_DECONTAMINATE = f"""WITH b AS (SELECT item_id::VARCHAR AS item, {_words(decontaminate.SEPARATORS)} AS w FROM benchmark), d AS (SELECT row_number() OVER () AS r, doc_id, {_words(decontaminate.SEPARATORS)} AS w FROM documents),
win AS (SELECT item, array_to_string(w[i:i+9], ' ') AS g, 10 AS n FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10) UNION SELECT item, array_to_string(w, ' '), len(w)::INT FROM b WHERE len(w) BETWEEN 1 AND 9),
grams AS (SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN (SELECT DISTINCT n FROM win) ON i + n - 1 <= len(w)),
hits AS (SELECT r, i, g.n, item FROM grams g JOIN win USING (g, n)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""

#: The tables' pages hold one article of headings and paragraphs, with b and br as the only other tags; SQL reads those.
_HTML_TEXT = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
blocks AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(a, '</?b>', '', 'g'), '<br>', ' '), '</?(?:h1|p)>'),
lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM a)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, length(array_to_string(l, chr(10)))::BIGINT AS n_chars FROM blocks"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": _NEAR_DEDUP, "op5_html_text": _HTML_TEXT, "op8_decontaminate": _DECONTAMINATE}
