"""Operators outside the llm subpackage, on small fixtures with values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.lexicon import FLAGGED, STRIP
from corpusmill.operators import dedup
from corpusmill.operators import scores as S
from corpusmill.operators import text as X
from corpusmill.operators.graph import components
from corpusmill.operators.windows import moving_cutoff


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()[0]


def _scores(text, lang="en"):
    words, lower = text.split(), text.lower().split()
    return S.ngram_score()(text, lang, words, lower), S.junk_share(text), S.lexicon_score(S.Lexicon(FLAGGED, shared="en", strip=STRIP))(text, lang, words, lower)


def test_ngram_score_leaves_out_the_last_window():
    assert _scores("a b c")[0] == 0.0
    assert _scores("a b c d")[0] == 0.25
    assert _scores("a b c a b c x")[0] == 2 / 7
    assert _scores("")[0] == 0.0
    # characters where a language is read by them: 3-grams of "abcabcx" but the last
    assert _scores("abcabcx", "ja")[0] == 2.0


def test_scripts_by_precedence(spark):
    assert _one(spark, "かな 漢", X.script_detect(F.col("text"))) == "zh"
    assert _one(spark, "かな", X.script_detect(F.col("text"))) == "ja"
    assert _one(spark, "abc", X.script_detect(F.col("text"))) is None


def test_empty_texts_have_defined_scores(spark):
    assert _one(spark, "", S.special_char_score(F.col("text"))) == 1.0
    assert _one(spark, None, S.special_char_score(F.col("text"))) == 1.0
    assert _scores("") == (0.0, 1.0, 0.0)


def test_lexicons_match_longest_terms_and_strip_marks():
    assert S.greedy_hits("a b c a b".split(), {"a b", "a b c", "b"}, 3, " ") == (2, 2)
    several = S.Lexicon({"xx": ["a b", "c"], "ja": ["ab"]}, none=1.0)
    assert several.hits("xx", "a b c d".split()) == (2, 3)
    assert several.share("ja", ["abx", "ab"]) == 2 / 3 * 1.5
    assert several.share("yy", ["a"]) == 1.0 and several.share("xx", []) == 0.0
    flagged = S.Lexicon(FLAGGED, shared="en", strip=STRIP)
    assert flagged.share("fr", ["idiot###", "ordure.", "***", "mot"]) == 2 / 3
    assert flagged.share(None, ["trash$$$"]) == 1.0
    assert S.banned_ratio(flagged, S.Lexicon({"en": ["scum"]}, strip=STRIP))("", "en", [], ["scum", "a"]) == 0.5 * 501


def test_flagged_terms_are_learned_by_language(spark):
    rows = [(i, "xx", "bad idea") for i in range(3)] + [(i, "xx", "good idea") for i in range(3, 20)] + [(20, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(20)] + [(20, None)], "doc_id long, toxic int")
    learned = S.flagged_terms(docs, labels)
    assert [tuple(r) for r in learned.collect()] == [("xx", "bad")]
    assert S.with_learned({"xx": ["x"]}, learned) == {"xx": {"x", "bad"}}
    with pytest.raises(ValueError):
        S.with_learned({}, learned, most=0)


def test_nulls_and_repeated_ids_lose_no_row(spark):
    rows = [(1, "a b. c d.", "en"), (2, None, None), (3, None, None), (None, "a b. c d.", "en"), (1, "other", "de"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for made in (dedup.exact_dedup(docs), dedup.simhash(docs), dedup.dup_clusters(docs), dedup.doc_dup_status(docs), dedup.span_dedup(docs), dedup.passages(docs)):
        assert made.count() == len(rows)
    firsts = {(r.doc_id, r.first_doc_id, r.is_dup) for r in dedup.exact_dedup(docs).collect()}
    assert firsts == {(1, 1, False), (2, 2, False), (3, 2, True), (None, 1, True), (4, 4, False)}
    scored = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (None, "en", 2.0), (3, "en", None), (3, "en", 1.0)], "doc_id long, lang string, score double")
    moved = {(r.doc_id, r.lang, r["mean"]) for r in moving_cutoff(scored, "lang", "doc_id", "score").collect()}
    assert {(1, None, 1.0), (2, None, 2.0), (None, "en", 2.0)} <= moved and len(moved) == 5
    empty = docs.limit(0)
    for made in (dedup.exact_dedup(empty), dedup.dup_clusters(empty), dedup.doc_dup_status(empty), dedup.span_dedup(empty), dedup.passages(empty)):
        assert made.count() == 0


def test_hot_groups_are_joined_by_broadcast(spark):
    from corpusmill.session import join_back

    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)] + [(99, "c")], "doc_id long, h string")
    groups = rows.groupBy("h").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    want = {(r.doc_id, r.low) for r in join_back(rows, groups, "h").collect()}
    assert {(r.doc_id, r.low) for r in join_back(rows, groups, "h", hot=5).collect()} == want and len(want) == 31


def test_span_dedup_by_hand(spark):
    run = "One two. Three four. Five six. Seven eight 9. Nine ten. "
    docs = spark.createDataFrame([(1, run + "End of one. Last."), (2, "Start. " + run.replace("9", "8") + "End of two. Last."), (3, "Start. " + run + "End of 2. Last. x"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.status, r.n_removed, r.text) for r in dedup.span_dedup(docs).collect()}
    assert got[1] == (0, 0, "One two. Three four. Five six. Seven eight 9. Nine ten. End of one. Last.")
    assert got[2][:2] == (1, 5) and got[2][2] == "Start. * End of two. Last."
    assert got[3][0] == 1 and got[4] == (0, 0, "")
    assert dedup.sentence_chunks("a. b!  " + "x" * 45) == ["a.", "b!", "x" * 20, "x" * 20, "x" * 5]


def test_passages_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [[rng.choice(vocabulary) for _ in range(k)] for k in (11, 14, 30)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for run in shared:
            if rng.random() < 0.5:
                at = rng.randint(0, len(words))
                words[at:at] = run[: rng.randint(8, len(run))]
        texts.append(" ".join(words))
    docs = spark.createDataFrame([*enumerate(texts), (98, None), (99, "")], "doc_id long, text string")
    runs = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 9):
            runs.setdefault(tuple(w[k : k + 10]), []).append((i, k))
    want = {}
    for i, t in enumerate(texts):
        w, gone, near = t.split(), set(), set()
        for places in runs.values():
            for j, k in places:
                if j == i and len({p for p, _ in places}) > 1:
                    near |= set(range(k, k + 10))
                if j == i and (j, k) != min(places):
                    gone |= set(range(k, k + 10))
        want[i] = (len(w), len(near), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    want |= {98: (0, 0, 0, ""), 99: (0, 0, 0, "")}
    assert {r.doc_id: (r.n_words, r.n_shared, r.n_removed, r.text) for r in dedup.passages(docs, size=10).collect()} == want


def test_normal_forms(spark):
    from corpusmill.operators import normalise as N

    def form(text, make):
        return _one(spark, text, make(F.col("text")))

    assert form(" Ab１2，“x”— ", N.lm_normalize) == 'ab00,"x" -  '
    assert form("a « b » c ( d ) , 1 2", lambda c: N.spacing_for_tok(c, F.lit("fr"))) == 'a "b" c (d), 1,2'
    assert form("1 2", lambda c: N.spacing_for_tok(c, F.lit("en"))) == "1.2"
    assert form("Yes! No. it's", N.norm_sentences) == "Yes!  No.  it 's" == N.norm_sentences_py("Yes! No. it's")
    assert form("a ... b?. c", N.clean_pseudo_punct) == "a . b? c" or form("b?. c", N.clean_pseudo_punct) == "b? c"
    assert form("x ###nav###0###Home###/nav### y ###img###1### z", N.strip_elements).split() == ["x", "y", "z"]
    assert [form(t, N.date_norm) for t in ("2020-01-31", "31.01.2020", "January 31, 2020", "20200131", "soon", None)] == ["01/31/20"] * 3 + [None] * 3
    assert [form(t, N.to_int) for t in ("12", " -3 ", "1.5", "x", "", None)] == [12, -3, None, None, None, None]
    rows = spark.createDataFrame([(1, "Élan Ñandú"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in N.strip_accents(rows, "text").collect()] == [(1, "Elan Nandu"), (2, None)]


def test_hamming_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(64) for _ in range(60)]
    codes += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in codes] + [c ^ 5 for c in codes]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(signed)], "doc_id long, simhash long")
    got = {(r.a, r.b, r.dist) for r in dedup.hamming_pairs(df).collect()}
    want = {(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_moving_cutoff_equals_a_plain_window(spark, monkeypatch):
    from corpusmill.operators import windows

    monkeypatch.setattr(windows, "BLOCK", 7)
    monkeypatch.setattr(windows, "BUCKET", 5)
    rng = random.Random(1)
    rows = [(i * 2, rng.choice("ab"), round(rng.random(), 3)) for i in range(80)]
    got = {r.doc_id: r["mean"] for r in moving_cutoff(spark.createDataFrame(rows, "doc_id long, lang string, score double"), "lang", "doc_id", "score", window=5).collect()}
    for lang in "ab":
        own = [r for r in rows if r[1] == lang]
        for k, r in enumerate(own):
            frame = [s for _, _, s in own[max(0, k - 4) : k + 1]]
            assert abs(got[r[0]] - sum(frame) / len(frame)) < 2e-6


def test_entry_without_the_llm_folders():
    import __spark_entry__

    assert "filter_funnel" in __spark_entry__.queries()
