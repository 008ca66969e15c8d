"""Scores, filters and moving statistics of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.lexicon import BANNED, FLAGGED, JUNK, STOPWORDS, STRIP, lang_group
from corpusmill.functions.sql import CJK, D, listed, quoted
from corpusmill.operators import dedup, language_model
from corpusmill.operators import scores as S
from corpusmill.operators import text as X
from corpusmill.operators.windows import moving_cutoff
from corpusmill.plans.duplicates import STATUS
from corpusmill.registry import query
from corpusmill.session import store, table

def _share(terms, w: str = "w") -> str:
    return f"CASE WHEN len({w}) = 0 THEN 0.0 ELSE round(len(list_filter({w}, lambda x: lower(x) IN {listed(terms)}))::DOUBLE / len({w}), 6) END"


STOP = "CASE " + " ".join(f"WHEN lang = '{k}' THEN {_share(v)}" for k, v in STOPWORDS.items()) + " ELSE 1.0 END"


def special_sql(text: str) -> str:
    return f"CASE WHEN length({text}) = 0 THEN 1.0 ELSE round((length({text}) - length(translate({text}, {quoted(JUNK)}, '')))::DOUBLE / length({text}), 6) END"


SPECIAL = special_sql("coalesce(text, '')")
SPECIAL_BARE = special_sql("array_to_string(w, '')")
NGRAM = f"""round(coalesce((SELECT max(c) FROM (SELECT count(*) c FROM (SELECT unnest(list_transform(range(1, greatest(len(p) - 2, 1)), lambda i: array_to_string(p[i:i+2], chr(1)))) g) GROUP BY g)), 0)::DOUBLE / (length(text) - length(replace(text, ' ', '')) + 1), 6)"""
#: Terms learned from labels, and all flagged terms by language; words without the marks at their ends.
BARE = f"list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: trim(x, {quoted(STRIP)})), lambda x: x <> '')"
_KNOWN = "(VALUES " + ", ".join(f"({quoted(k)}, {quoted(t)})" for k, ts in FLAGGED.items() for t in ts) + ") v(lang, term)"
LEARNED = f"""labelled AS (SELECT doc_id, lang, toxic, unnest(list_distinct({BARE})) AS term FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)),
totals AS (SELECT lang, sum(toxic) AS all_toxic, sum(1 - toxic) AS all_clean FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1) GROUP BY lang),
learned AS (SELECT l.lang, l.term FROM labelled l JOIN totals t ON l.lang IS NOT DISTINCT FROM t.lang GROUP BY l.lang, l.term, all_toxic, all_clean
HAVING sum(toxic) >= 3 AND sum(toxic) * all_clean > 100 * sum(1 - toxic) * all_toxic)"""
FLAGS = f"""{LEARNED}, terms AS (SELECT lang, term FROM learned UNION SELECT lang, term FROM {_KNOWN}),
bare AS (SELECT doc_id, lang, text, {BARE} AS b FROM documents), units AS (SELECT doc_id, lang, lower(unnest(b)) AS term FROM bare),
flags AS (SELECT d.doc_id, d.lang, CASE WHEN len(b) = 0 THEN 0.0 ELSE round(coalesce(n, 0)::DOUBLE / len(b), 6) END AS flagged FROM bare d LEFT JOIN
(SELECT u.doc_id, count(*) AS n FROM units u WHERE EXISTS (SELECT 1 FROM terms t WHERE t.term = u.term AND (t.lang = u.lang OR t.lang = 'en')) GROUP BY u.doc_id) h ON h.doc_id = d.doc_id)"""


def _docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents", *(columns or ("doc_id", "text", "lang")))


def _flagged(spark, sf_dir) -> S.Lexicon:
    """The lists with terms learned from all labelled rows; the language's and the English ones count."""
    learned = S.flagged_terms(_docs(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return S.Lexicon(S.with_learned(FLAGGED, learned), shared="en", strip=STRIP)


_STOP = S.Lexicon(STOPWORDS, none=1.0)


@query(f"SELECT doc_id, {SPECIAL} AS score FROM documents")
def special_char_score(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.special_char_score(F.col("text")).alias("score"))


@query(f"SELECT doc_id, CASE WHEN length(s) > 0 THEN round((length(s) - length(translate(s, {quoted(JUNK)}, '')))::DOUBLE / length(s), 6) END AS ratio FROM (SELECT doc_id, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12))) AS s FROM documents)")
def junk_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.junk_ratio(F.col("text")).alias("ratio"))


@query(f"SELECT doc_id, {NGRAM} AS score FROM {D}")
def ngram_score(spark, sf_dir):
    return S.text_scores(_docs(spark, sf_dir), {"score": S.ngram_score()}, keep=["doc_id"])


@query(f"SELECT doc_id, lang, {STOP} AS score FROM {D}")
def stopword_score(spark, sf_dir):
    return S.text_scores(_docs(spark, sf_dir), {"score": S.lexicon_score(_STOP)})


_STOP_BARE = "CASE " + " ".join(f"WHEN lang = '{k}' THEN {_share(v, 'b')}" for k, v in STOPWORDS.items()) + " ELSE 0.0 END"


@query(f"SELECT doc_id, lang, {_STOP_BARE} AS ratio FROM (SELECT doc_id, lang, {BARE} AS b FROM documents)")
def stopword_ratio(spark, sf_dir):
    """The extractor's variant: words without the marks at their ends; 0 where a language has no list."""
    return S.text_scores(_docs(spark, sf_dir), {"ratio": S.lexicon_score(S.Lexicon(STOPWORDS, strip=STRIP))})


@query(f"WITH {LEARNED} SELECT lang, term FROM learned")
def flagged_terms(spark, sf_dir):
    return S.flagged_terms(_docs(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query(f"WITH {FLAGS} SELECT doc_id, lang, flagged AS score FROM flags")
def flagged_score(spark, sf_dir):
    return S.text_scores(_docs(spark, sf_dir), {"score": S.lexicon_score(_flagged(spark, sf_dir))})


@query(f"WITH {FLAGS}, banned AS (SELECT u.doc_id, count(*) AS n FROM units u WHERE u.term IN ('scum', 'trash') GROUP BY u.doc_id) SELECT f.doc_id, f.lang, round(flagged * (1 + 1000 * coalesce(n, 0)::DOUBLE / greatest(len(b), 1)), 2) AS ratio FROM flags f JOIN bare USING (doc_id) LEFT JOIN banned USING (doc_id)")
def flagged_banned_ratio(spark, sf_dir):
    """Flagged share weighed by banned terms; two terms stand for a caller's list."""
    banned = S.Lexicon({**BANNED, "en": ("scum", "trash")}, shared="en", strip=STRIP)
    made = S.text_scores(_docs(spark, sf_dir), {"flagged": S.lexicon_score(flagged := _flagged(spark, sf_dir)), "weight": lambda v, lang, w, low: 1 + 1000 * banned.hits(lang, low)[0] / max(1, len(flagged.units(lang, low)))})
    return made.select("doc_id", "lang", F.round(F.col("flagged") * F.col("weight"), 2).alias("ratio"))


@query(r"""SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(list_sum(list_transform(w, lambda x: (length(x) - length(replace(x, '_', ''))) ** 2)) / len(w), 6) END AS ratio FROM """ + D)
def compound_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.compound_ratio(F.col("text")).alias("ratio"))


_VOTES = ", ".join(f"{_share(v)} AS s_{k}" for k, v in STOPWORDS.items())
_BEST = "greatest(" + ", ".join(f"s_{k}" for k in STOPWORDS) + ")"


@query(f"SELECT doc_id, lang, CASE {' '.join(f'''WHEN s_{k} = {_BEST} THEN '{k}' ''' for k in sorted(STOPWORDS))} END AS vote, {_BEST} AS score FROM (SELECT *, {_VOTES} FROM {D})")
def lang_vote(spark, sf_dir):
    """The language whose stop words fill most of the text; ties go to the first code."""
    shares = {f"s_{k}": (lambda v, lang, w, low, terms=frozenset(t): sum(map(terms.__contains__, low)) / len(low) if low else 0.0) for k, t in STOPWORDS.items()}
    rows = S.text_scores(_docs(spark, sf_dir), shares)
    best = F.greatest(*(f"s_{k}" for k in STOPWORDS))
    vote = F.coalesce(*(F.when(F.col(f"s_{k}") == best, F.lit(k)) for k in sorted(STOPWORDS)))
    return rows.select("doc_id", "lang", vote.alias("vote"), best.alias("score"))


_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in X.SCRIPTS) + " END"
_GROUP = "CASE " + " ".join(f"WHEN lang = '{k}' THEN vote IN {listed(lang_group(k))}" for k in STOPWORDS) + " ELSE vote = lang END"
_OWN = "CASE " + " ".join(f"WHEN vote = '{k}' THEN s_{k}" for k in STOPWORDS) + " END"
_FIRST = "CASE " + " ".join(f"WHEN s_{k} > 0.2 THEN '{k}'" for k in STOPWORDS) + " END"
_FIRST_SCORE = "CASE " + " ".join(f"WHEN s_{k} > 0.2 THEN s_{k}" for k in STOPWORDS) + " END"


@query(f"""WITH a AS (SELECT doc_id, lang, {_SCRIPT} AS script, {_VOTES} FROM {D}), b AS (SELECT *, CASE {' '.join(f"WHEN s_{k} = {_BEST} THEN '{k}' " for k in sorted(STOPWORDS))} END AS vote, least(1.0, 2 * {_BEST}) AS base FROM a),
c AS (SELECT *, CASE WHEN (lang IS DISTINCT FROM vote OR (base > 0.3 AND base < 0.5)) AND coalesce({_GROUP}, false) THEN base * 1.5 ELSE base END AS s1 FROM b),
d AS (SELECT *, CASE WHEN s1 > 0.3 AND s1 < 0.5 AND {_OWN} > 0.2 THEN s1 * 1.5 ELSE s1 END AS s2 FROM c),
e AS (SELECT doc_id, script, CASE WHEN s2 < 0.5 THEN coalesce({_FIRST}, vote) ELSE vote END AS l, CASE WHEN s2 < 0.5 THEN coalesce(0.3 + {_FIRST_SCORE}, s2) ELSE s2 END AS s3 FROM d)
SELECT doc_id, CASE WHEN s3 < 0.5 AND script IS NOT NULL THEN script ELSE l END AS lang_id, round(CASE WHEN s3 < 0.5 AND script = l THEN s3 + 0.3 WHEN s3 < 0.5 AND script IS NOT NULL THEN 1 - s3 ELSE s3 END, 6) AS score FROM e""")
def lang_id(spark, sf_dir):
    """Language by two opinions and the rules between them; here the stop-word vote and the table's label stand for the two models."""
    shares = {f"s_{k}": (lambda v, lang, w, low, terms=frozenset(t): sum(map(terms.__contains__, low)) / len(low) if low else 0.0) for k, t in STOPWORDS.items()}
    with_script = _docs(spark, sf_dir).withColumn("script", X.script_detect(F.col("text")))
    rows = S.text_scores(with_script, shares, keep=["doc_id", "lang", "script"])
    best = F.greatest(*(f"s_{k}" for k in STOPWORDS))
    vote = F.coalesce(*(F.when(F.col(f"s_{k}") == best, F.lit(k)) for k in sorted(STOPWORDS)))
    rows = rows.withColumns({"vote": vote, "base": F.least(F.lit(1.0), 2 * best)})
    return rows.select("doc_id", *X.lang_rules("vote", "base", "lang", {k: f"s_{k}" for k in STOPWORDS}, "script"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in X.SCRIPTS) + " END AS script FROM documents")
def script_detect(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.script_detect(F.col("text")).alias("script"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]', '', 'g')) AS digest FROM documents")
def emoji_strip(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.emoji_strip(F.col("text")).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\p{Nd}', '1', 'g')) AS digest FROM documents")
def mask_digits(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.mask_digits(F.col("text")).cast("binary")).alias("digest"))


_MOVING = """SELECT *, round(mean - 2 * sd, 6) AS cutoff, coalesce(score >= round(mean - 2 * sd, 6), true) AS keep FROM (
SELECT doc_id, lang, score, round(avg((score * 1e6)::BIGINT) OVER f / 1e6, 6) AS mean, round(stddev_samp(score) OVER f, 6) AS sd FROM ({rows})
WINDOW f AS (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))"""


@query(_MOVING.format(rows=f"SELECT doc_id, lang, {STOP} AS score FROM {D}"))
def moving_cutoffs(spark, sf_dir):
    return moving_cutoff(stopword_score(spark, sf_dir), "lang", "doc_id", "score")


_FIRST_REASON = "CASE WHEN n = 0 THEN 'empty' WHEN special > 0.4 THEN 'special' WHEN n < 30 THEN 'length' WHEN ngram >= 0.8 OR special >= 0.28 THEN 'train' WHEN flagged >= 0.08 THEN 'flagged' END"
_SCORED = f"""scored AS (SELECT d.doc_id, d.lang, CASE WHEN d.lang IN {CJK} THEN length(array_to_string(w, '')) ELSE len(w) END AS n, {SPECIAL_BARE} AS special, {NGRAM} AS ngram, {STOP} AS score, flagged
FROM {D} d JOIN (SELECT doc_id AS flag_id, flagged FROM flags) f ON flag_id = d.doc_id)"""
_FUNNEL = f"""WITH {FLAGS}, {_SCORED}, s AS (SELECT doc_id, lang, {_FIRST_REASON} AS reason, score FROM scored),
m AS ({_MOVING.format(rows="SELECT * FROM s WHERE reason IS NULL")})
SELECT lang, reason, count(*)::BIGINT AS n FROM (
SELECT lang, reason FROM s WHERE reason IS NOT NULL UNION ALL SELECT lang, CASE WHEN keep THEN 'ok' ELSE 'stopword' END FROM m) GROUP BY lang, reason"""


def _scored(spark, sf_dir):
    """doc_id, lang, n, special, ngram, score (stop words), flagged: one pass, stored."""
    wanted = {"n": S.n_units, "special": S.special_without_space, "ngram": S.ngram_score(), "score": S.lexicon_score(_STOP), "flagged": S.lexicon_score(_flagged(spark, sf_dir))}
    return store(S.text_scores(_docs(spark, sf_dir), wanted), "scored")


@query(_FUNNEL)
def filter_funnel(spark, sf_dir):
    """Documents by language and first reason to reject; a filter sees what passed those before it."""
    rows = _scored(spark, sf_dir).select("doc_id", "lang", "score", F.expr(_FIRST_REASON).alias("reason"))
    left = moving_cutoff(rows.filter("reason IS NULL").drop("reason"), "lang", "doc_id", "score")
    judged = left.select("lang", F.when(F.col("keep"), "ok").otherwise("stopword").alias("reason"))
    return rows.filter("reason IS NOT NULL").select("lang", "reason").unionByName(judged).groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"))


_PPL = f"ppl AS ({language_model.SQL.format(D=D)})"
_MOVING_UP = """SELECT *, coalesce(ppl <= round(mean + 2 * sd, 6), true) AS keep FROM (
SELECT doc_id, lang, ppl, round(avg((ppl * 1e6)::BIGINT) OVER f / 1e6, 6) AS mean, round(stddev_samp(ppl) OVER f, 6) AS sd FROM ({rows})
WINDOW f AS (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_PPL} SELECT doc_id, lang, ppl, round(mean + 2 * sd, 6) AS cutoff, keep FROM ({_MOVING_UP.format(rows='SELECT doc_id, lang, ppl FROM ppl JOIN documents USING (doc_id)')})")
def perplexity_cutoffs(spark, sf_dir):
    """Perplexity against mean + 2 deviations of the language's last 500."""
    ppl = language_model.perplexity(_docs(spark, sf_dir)).join(_docs(spark, sf_dir, "doc_id", "lang"), "doc_id")
    return moving_cutoff(ppl, "lang", "doc_id", "ppl", upper=2.0).select("doc_id", "lang", "ppl", "cutoff", "keep")


_RECORD = f"""WITH {FLAGS}, {_SCORED}, {STATUS}, {_PPL}, votes AS (SELECT doc_id, {_VOTES} FROM {D}),
s1 AS (SELECT x.doc_id, x.lang, x.score, x.ngram, x.special, x.flagged, coalesce(ppl.ppl, 0.0) AS ppl,
CASE WHEN st.status = 2 THEN 'duplicate' WHEN n = 0 THEN 'empty' WHEN special > 0.4 THEN 'special' WHEN {_BEST} < 0.1 THEN 'language' WHEN n < 30 THEN 'length' END AS reason
FROM scored x JOIN status st USING (doc_id) JOIN votes USING (doc_id) LEFT JOIN ppl USING (doc_id)),
m1 AS ({_MOVING.format(rows="SELECT * FROM s1 WHERE reason IS NULL")}),
s2 AS (SELECT s1.* FROM s1 JOIN m1 USING (doc_id) WHERE m1.keep), m2 AS ({_MOVING_UP.format(rows="SELECT * FROM s2")}),
s3 AS (SELECT s2.lang, CASE WHEN NOT m2.keep THEN 'perplexity' WHEN ngram >= 0.8 OR special >= 0.28 OR flagged >= 0.08 THEN 'train' ELSE 'ok' END AS reason FROM s2 JOIN m2 USING (doc_id))
SELECT lang, reason, count(*)::BIGINT AS n FROM (SELECT lang, reason FROM s1 WHERE reason IS NOT NULL UNION ALL SELECT lang, 'stopword' FROM m1 WHERE NOT keep UNION ALL SELECT lang, reason FROM s3) GROUP BY lang, reason"""


@query(_RECORD)
def record_funnel(spark, sf_dir):
    """All filters of a page record in their order: near duplicate, empty, special characters, language, length,
    moving stop-word and perplexity cut-offs, training filter."""
    docs = _docs(spark, sf_dir)
    status = dedup.doc_dup_status(docs)
    ppl = language_model.perplexity(docs)
    votes = {"vote": lambda v, lang, w, low: max(sum(map(t.__contains__, low)) / len(low) if low else 0.0 for t in map(frozenset, STOPWORDS.values()))}
    rows = _scored(spark, sf_dir).join(status, "doc_id").join(S.text_scores(docs, votes, keep=["doc_id"]), "doc_id").join(ppl, "doc_id", "left")
    reason = "CASE WHEN status = 2 THEN 'duplicate' WHEN n = 0 THEN 'empty' WHEN special > 0.4 THEN 'special' WHEN vote < 0.1 THEN 'language' WHEN n < 30 THEN 'length' END"
    first = store(rows.select("doc_id", "lang", "score", "ngram", "special", "flagged", F.coalesce("ppl", F.lit(0.0)).alias("ppl"), F.expr(reason).alias("reason")), "first")
    stop = store(moving_cutoff(first.filter("reason IS NULL").drop("reason"), "lang", "doc_id", "score"), "stop")
    last = moving_cutoff(stop.filter("keep").drop("mean", "sd", "cutoff", "keep"), "lang", "doc_id", "ppl", upper=2.0)
    train = (F.col("ngram") >= 0.8) | (F.col("special") >= 0.28) | (F.col("flagged") >= 0.08)
    ends = last.select("lang", F.when(~F.col("keep"), "perplexity").when(train, "train").otherwise("ok").alias("reason"))
    out = first.filter("reason IS NOT NULL").select("lang", "reason").unionByName(stop.filter("NOT keep").select("lang", F.lit("stopword").alias("reason"))).unionByName(ends)
    return out.groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, doc_id, n_chars, rank FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 10")
def topk_per_lang(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return _docs(spark, sf_dir, "lang", "doc_id", "n_chars").withColumn("rank", rank).filter("rank <= 10")
