"""Normal forms of texts, codes and addresses, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.lexicon import CJK_LANGS, LANG_GROUPS, lang_group
from corpusmill.operators import normalise as N
from corpusmill.operators.pages import links
from corpusmill.functions.sql import quoted, replace_sql
from corpusmill.registry import query
from corpusmill.session import table


def _rules_sql(text: str, rules) -> str:
    for old, new, pattern in rules:
        if old == "\r":
            text = f"replace({text}, chr(13), '')"
        else:
            text = f"regexp_replace({text}, {quoted(old)}, {quoted(new)}, 'g')" if pattern else f"replace({text}, {quoted(old)}, {quoted(new)})"
    return text


def _strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _collapse_sql(text: str) -> str:
    return _strip_sql(rf"regexp_replace({text}, '\s+', ' ', 'g')")


_SINGLE = {k: v for k, v in N.PUNCT.items() if len(v) == 1}
_LONGER = [(k, v) for k, v in N.PUNCT.items() if len(v) > 1]


def _punct_sql(text: str) -> str:
    return replace_sql(f"translate({text}, {quoted(''.join(_SINGLE))}, {quoted(''.join(_SINGLE.values()))})", _LONGER)


_CONTROL = r"[\x00-\x1F\x7F-\x{9F}]"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang")


def _digest(spark, sf_dir, column):
    return _docs(spark, sf_dir).select("doc_id", F.md5(column.cast("binary")).alias("digest"))


#: Texts with the marks that the driver's texts hardly hold, so that rules meet something.
_MARKED = "text || ' « a » (b) 1 2 % — “c”, ok. It’s 3．「d」 … end. . next!. x`s'"


def _marked():
    return F.concat(F.col("text"), F.lit(_MARKED.split("|| ")[1].strip("'")))


def _sql(expression: str) -> str:
    return f"SELECT doc_id, md5({expression}) AS digest FROM (SELECT doc_id, lang, {_MARKED} AS text FROM documents)"


@query(_sql(_punct_sql("text")))
def unicode_punct_norm(spark, sf_dir):
    return _digest(spark, sf_dir, N.unicode_punct(_marked()))


@query(_sql(f"translate(text, {quoted(''.join(N.PUNCT))}, '')"))
def unicode_punct_remove(spark, sf_dir):
    return _digest(spark, sf_dir, N.unicode_punct(_marked(), remove=True))


@query(_sql(f"regexp_replace(text, '{_CONTROL}', '', 'g')"))
def non_printing(spark, sf_dir):
    return _digest(spark, sf_dir, N.non_printing(_marked()))


_LM = f"regexp_replace({_punct_sql(f'''regexp_replace(lower({_strip_sql('text')}), '{chr(92)}p{{Nd}}', '0', 'g')''')}, '{_CONTROL}', '', 'g')"


@query(_sql(_LM))
def lm_normalize(spark, sf_dir):
    return _digest(spark, sf_dir, N.lm_normalize(_marked()))


@query("SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def strip_accents(spark, sf_dir):
    return N.strip_accents(_docs(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_SPACED = _rules_sql("text", N.SPACING)
_QUOTES = f"CASE WHEN lang = 'en' THEN {_rules_sql('s', N.SPACING_EN)} WHEN lang IN {N.NO_QUOTE_RULE} THEN s ELSE {_rules_sql('s', N.SPACING_OTHER)} END"


@query(rf"""SELECT doc_id, md5(CASE WHEN lang IN {N.COMMA} THEN regexp_replace(q, '(\d) (\d)', '\1,\2', 'g') ELSE regexp_replace(q, '(\d) (\d)', '\1.\2', 'g') END) AS digest FROM (
SELECT doc_id, lang, {_QUOTES} AS q FROM (SELECT doc_id, lang, {_SPACED} AS s FROM (SELECT doc_id, lang, {_MARKED} AS text FROM documents)))""")
def spacing_for_tok(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(N.spacing_for_tok(_marked(), F.col("lang")).cast("binary")).alias("digest"))


@query(_sql(replace_sql("text", N.SENTENCE_ENDS)))
def norm_sentences(spark, sf_dir):
    return _digest(spark, sf_dir, N.norm_sentences(_marked()))


@query(_sql(_collapse_sql(replace_sql("text", N.PSEUDO_ENDS))))
def clean_pseudo_punct(spark, sf_dir):
    return _digest(spark, sf_dir, N.clean_pseudo_punct(_marked()))


def _elements_sql(text: str) -> str:
    text = f"replace({_collapse_sql(text)}, '###/', '▁/')"
    for kind in N.ELEMENTS:
        text = rf"regexp_replace({text}, '###{kind}###\d+###[^▁]+▁/{kind}###', '  ', 'g')"
    for marks in N.ELEMENT_MARKS:
        text = f"regexp_replace({text}, {quoted(marks)}, '  ', 'g')"
    return text


@query(f"SELECT doc_id, md5({_elements_sql('text')}) AS digest FROM (SELECT doc_id, '###nav###0###Home | ' || lang || '###/nav### ###title###0###' || source || '###/title### ' || text AS text FROM documents)")
def strip_elements(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    marked = F.concat(F.lit("###nav###0###Home | "), "lang", F.lit("###/nav### ###title###0###"), "source", F.lit("###/title### "), "text")
    return docs.select("doc_id", F.md5(N.strip_elements(marked).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, lang IN {CJK_LANGS} AS by_char FROM documents")
def lang_is_cjk(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.col("lang").isin(*CJK_LANGS).alias("by_char"))


_MEMBERS = [(code, member) for names, _ in LANG_GROUPS for code in names.split() for member in lang_group(code)]


@query("SELECT DISTINCT lang, coalesce(member, lang) AS member FROM documents LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MEMBERS) + ") v(code, member) ON code = lang")
def lang_groups(spark, sf_dir):
    """Languages of the table and those each may be taken for."""
    groups = spark.createDataFrame(sorted(set(_MEMBERS)), "code string, member string")
    rows = _docs(spark, sf_dir).select("lang").distinct().join(F.broadcast(groups), F.col("lang") == F.col("code"), "left")
    return rows.select("lang", F.coalesce("member", "lang").alias("member")).distinct()


_DATE = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE CAST(o_orderkey AS VARCHAR) END"


@query(f"SELECT o_orderkey, {_DATE} AS raw, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%m/%d/%y') END AS date FROM orders")
def date_norm(spark, sf_dir):
    """Order dates written in several forms, read again; plain numbers are no dates."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    raw = F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 1, F.date_format(day, "dd.MM.yyyy")).when(key % 4 == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(key.cast("string"))
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", raw.alias("raw"))
    return rows.withColumn("date", N.date_norm(F.col("raw")))


@query(r"SELECT doc_id, count(*)::BIGINT AS n, sum(v)::DOUBLE AS total FROM (SELECT doc_id, TRY_CAST(w AS BIGINT) AS v FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE regexp_matches(w, '^[+-]?[0-9]{1,18}$')) GROUP BY doc_id")
def to_int(spark, sf_dir):
    """How many words of a text are whole numbers, and their sum."""
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).select("doc_id", N.to_int(F.col("w")).alias("v")).filter("v IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))


@query("SELECT event_id, props ->> '$.page' AS page, coalesce(props ->> '$.missing', event_type) AS pick FROM events")
def json_pick(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    return events.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.coalesce(F.get_json_object("props", "$.missing"), F.col("event_type")).alias("pick"))


@query("""SELECT page_id, i - 1 AS n, regexp_extract(url, '^[a-z]+://[^/?#]*') || l[i] AS link FROM (SELECT page_id, url, l, unnest(range(1, len(l) + 1)) AS i FROM (
SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS l FROM pages))""")
def absolute_links(spark, sf_dir):
    """Links of each page in order, joined to the page's address by a parser."""
    return links(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", F.col("n").cast("long").alias("n"), "link")
