"""Perplexity, compounds, spans, overlap with benchmark items, personal data with context."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.sql import D
from corpusmill.operators import language_model, pages, personal, spans
from corpusmill.operators import text as X
from corpusmill.operators import scores as S
from corpusmill.plans.scores import FLAGS, NGRAM, SPECIAL, _flagged
from corpusmill.registry import query
from corpusmill.session import broadcast_if_small, table


def _docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


_BIGRAMS = f"big AS ({language_model.BIGRAMS.format(D=D)})"


@query(language_model.SQL.format(D=D))
def perplexity(spark, sf_dir):
    return language_model.perplexity(_docs(spark, sf_dir))


@query(f"""WITH {_BIGRAMS} SELECT a AS first, b AS second, sum(n)::BIGINT AS n FROM big GROUP BY a, b HAVING sum(n) >= 20""")
def compound_candidates(spark, sf_dir):
    return language_model.compounds(_docs(spark, sf_dir))


_LINES = """(SELECT doc_id, (i - 1)::BIGINT AS line_no, l[i] AS line, n, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS pos
FROM (SELECT doc_id, length(text) AS n, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE l[i] <> '')"""


@query(f"SELECT doc_id, line_no, pos, round(pos::DOUBLE / n, 6) AS share, md5(line) AS digest FROM {_LINES}")
def line_index(spark, sf_dir):
    """Lines with their offsets (the indexer's rows)."""
    return spans.lines(_docs(spark, sf_dir)).withColumn("digest", F.md5(F.col("line").cast("binary"))).drop("line")


@query(f"""SELECT doc_id, line_no, CASE WHEN round(pos::DOUBLE / n, 6) < 0.05 THEN 'intro' WHEN round(pos::DOUBLE / n, 6) >= 0.95 THEN 'conclusion'
WHEN length(line) < 50 AND regexp_matches(line, '^[A-Z]') AND regexp_matches(line, '(^| )[A-Z][^ ]*$') THEN 'section' END AS prefix FROM {_LINES}""")
def prefix_labels(spark, sf_dir):
    return spans.prefix_labels(spans.lines(_docs(spark, sf_dir)))


def _end(start: str) -> str:
    """SQL text: where the span from ``start`` (characters before it) on ends."""
    rest = f"substr(t, {start} + 1001, 1002)"
    marks = ", ".join(f"coalesce(nullif(instr({rest}, '{mark}'), 0), 9999)" for mark in (". ", "? ", "! "))
    return f"CASE WHEN length(t) <= {start} + 1000 THEN length(t) WHEN least({marks}) <= 1000 THEN {start} + 1000 + least({marks}) WHEN instr(substr({rest}, 1, 1000), ' ') > 0 THEN {start} + 999 + instr({rest}, ' ') ELSE least(length(t), {start} + 2000) END"


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents), s AS (
SELECT doc_id, t, 0 AS span_no, 0 AS start, {_end('0')} AS stop FROM t WHERE length(t) > 0 UNION ALL SELECT doc_id, t, span_no + 1, stop, {_end('stop')} FROM s WHERE stop < length(t))
SELECT doc_id, span_no::BIGINT AS span_no, start::BIGINT AS start, md5(trim(substr(t, start + 1, stop - start))) AS digest FROM s""")
def span_index(spark, sf_dir):
    """Spans of a thousand characters and more, cut at sentence ends."""
    return spans.consolidate(_docs(spark, sf_dir)).select("doc_id", "span_no", "start", F.md5(F.col("span").cast("binary")).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(l[i], '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT *, coalesce(sum(CASE WHEN length(line) >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM l WHERE line <> '')
SELECT doc_id, max(line_no)::BIGINT AS line_no, md5(string_agg(line, ' ' ORDER BY line_no)) AS digest FROM k GROUP BY doc_id, g""")
def merged_lines(spark, sf_dir):
    """Short lines joined to the next."""
    return spans.merge_short(_docs(spark, sf_dir)).select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("digest"))


_BOXES = "SELECT event_id // 12 AS image, (event_id % 3)::INT AS reader, event_id AS ord, ((event_id * 37) % 500 + 1)::DOUBLE AS x, ((event_id * 91) % 300 + 1)::DOUBLE AS y, event_type || ' ' || user_id AS text, ((event_id * 61) % 100) / 100.0::DOUBLE AS prob FROM events"


@query(rf"""WITH b AS ({_BOXES}), m AS (SELECT *, max(x) OVER o AS max_x, max(y) OVER o AS max_y FROM b WINDOW o AS (PARTITION BY image, reader ORDER BY ord)),
k AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py FROM m WHERE prob > 0.35 WINDOW o AS (PARTITION BY image, reader ORDER BY ord)),
p AS (SELECT image, reader, ord, prob, text || CASE WHEN sqrt(((px - x) / max_x) ** 2 + ((py - y) / max_y) ** 2) > 0.7 AND NOT regexp_matches(text, '[\p{{P}}\s]$') THEN '.' ELSE '' END AS piece FROM k),
t AS (SELECT image, reader, round(avg(prob), 6) AS score, trim(string_agg(piece, ' ' ORDER BY ord)) AS text FROM p GROUP BY image, reader),
u AS (SELECT * FROM t WHERE length(text) >= 20 AND len(regexp_extract_all(text, '[0-9]')) <= length(text) / 3.0),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY CASE WHEN score >= 0.7 THEN 0 ELSE 1 END, CASE WHEN score >= 0.7 THEN reader ELSE -score END, reader) AS rank FROM u)
SELECT image::BIGINT AS image, reader, score, text || CASE WHEN regexp_matches(text, '[\p{{P}}\s]$') THEN '' ELSE '.' END AS text FROM r WHERE rank = 1""")
def ocr_choice(spark, sf_dir):
    """The reader chosen for each image; events stand for boxes."""
    i = F.col("event_id")
    boxes = table(spark, sf_dir, "events", "event_id", "event_type", "user_id").select(
        F.floor(i / 12).alias("image"), (i % 3).cast("int").alias("reader"), i.alias("ord"), ((i * 37) % 500 + 1).cast("double").alias("x"), ((i * 91) % 300 + 1).cast("double").alias("y"),
        F.concat("event_type", F.lit(" "), "user_id").alias("text"), ((i * 61) % 100 / F.lit(100.0)).alias("prob"),
    )
    return spans.ocr_choice(boxes)


@query()
def pii_entities(spark, sf_dir):
    """Entities by rules with context, one row each (tested on fixtures)."""
    found = personal.entities(_docs(spark, sf_dir))
    return found.select("doc_id", F.explode("ents").alias("e")).select("doc_id", "e.*")


@query()
def entity_counts(spark, sf_dir):
    """Entities of each tag in each text (tested on fixtures)."""
    return personal.entity_counts(_docs(spark, sf_dir))


@query()
def generalized_text(spark, sf_dir):
    """Texts with personal data by the names of their kinds (tested on fixtures)."""
    docs = _docs(spark, sf_dir)
    met = docs.join(personal.entities(docs).withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")))
    kinds = {"EMAIL": "The Address", "PHONE": "The Number", "IP_ADDRESS": "The Host", "DATE": "The Date", "ID": "The Identifier", "KEY": "The Key"}
    return spans.generalize(met, kinds)


@query()
def page_elements(spark, sf_dir):
    return pages.page_elements(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def _grams_sql(name: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM {name})"


@query(f"SELECT doc_id, item_id, count(*)::BIGINT AS shared FROM ({_grams_sql('documents', 'doc_id')}) JOIN ({_grams_sql('benchmark', 'item_id')}) USING (g) GROUP BY doc_id, item_id")
def benchmark_overlap(spark, sf_dir):
    """Distinct word 8-grams that a document shares with an item."""
    def grams(name, key):
        made = X.ngrams(F.col("w"), 8, drop_last=False)
        rows = table(spark, sf_dir, name, key, "text").select(key, F.explode(F.array(X.words(F.lower("text")))).alias("w"))
        return rows.select(key, F.explode(F.array_distinct(made)).alias("g"))

    items = broadcast_if_small(grams("benchmark", "item_id").distinct(), 1_000_000)
    return grams("documents", "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


_WEAK = f"SELECT d.doc_id, (CASE WHEN len(w) < 30 THEN -1 ELSE 1 END + CASE WHEN {SPECIAL} > 0.2 THEN -1 ELSE 1 END + CASE WHEN ng > 0.1 THEN -1 ELSE 1 END + CASE WHEN flagged > 0.02 THEN -1 ELSE 1 END + CASE WHEN regexp_matches(text, '[.!?][ \n]*$') THEN 1 ELSE -1 END)::BIGINT AS votes FROM (SELECT *, {NGRAM} AS ng FROM {D}) d JOIN flags f ON f.doc_id = d.doc_id"


@query(f"WITH {FLAGS} SELECT doc_id, votes, (votes > 0) AS good FROM ({_WEAK})")
def weak_labels(spark, sf_dir):
    """Five labelling functions and their majority."""
    wanted = {
        "n": lambda v, lang, w, low: len(w), "special": lambda v, lang, w, low: S.junk_share(v), "ngram": S.ngram_score(),
        "flagged": S.lexicon_score(_flagged(spark, sf_dir)), "ends": lambda v, lang, w, low: bool(w) and w[-1][-1] in ".!?",
    }
    rows = S.text_scores(_docs(spark, sf_dir, "doc_id", "lang", "text"), wanted)
    tests = (F.col("n") >= 30, F.col("special") <= 0.2, F.col("ngram") <= 0.1, F.col("flagged") <= 0.02, F.col("ends") == 1)
    votes = sum((F.when(t, 1).otherwise(-1) for t in tests), F.lit(0))
    return rows.select("doc_id", votes.cast("long").alias("votes")).withColumn("good", F.col("votes") > 0)


@query()
def page_positions(spark, sf_dir):
    """Where elements stand in the pages' texts (tested on fixtures)."""
    records = pages.page_records(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return pages.positions(records.filter("reason IS NULL"))


@query("""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) <> '' AS has_title, len(regexp_extract_all(html, '<nav>'))::BIGINT AS navs, len(regexp_extract_all(html, '<footer>'))::BIGINT AS footers FROM pages""")
def page_element_counts(spark, sf_dir):
    """Elements of each page by the parser, counted."""
    records = pages.page_records(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    navs = F.size(F.filter("elements", lambda e: (e["kind"] == "nav") & ~F.startswith(e["val"], F.lit("©"))))
    every = F.size(F.filter("elements", lambda e: e["kind"] == "nav"))
    return records.select("page_id", F.col("title").isNotNull().alias("has_title"), navs.cast("long").alias("navs"), (every - navs).cast("long").alias("footers"))
