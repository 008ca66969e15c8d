"""What must hold at sizes that tests can't reach."""

import math
import random
from collections import Counter

import pytest

from corpusmill.operators import dedup, lexical, ngrams
from corpusmill.session import store


def test_exploded_keys_are_never_broadcast(spark):
    docs = spark.createDataFrame([(i, f"w{i} a b c d e f g h") for i in range(50)], "doc_id long, text string")
    pairs = dedup.hamming_pairs(dedup.simhash(docs), distance=3)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("== Initial Plan ==")[0]


def _texts(rows=120, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choice("a b c d e f g h é ퟿".split()) for _ in range(rng.randrange(60))) for _ in range(rows)]


@pytest.mark.parametrize("group", [None, "lang"])
def test_no_hash_of_an_ngram_goes_to_the_driver(spark, monkeypatch, group):
    texts = _texts()
    docs = spark.createDataFrame([(t, ["en", "d\te\n", None][i % 3]) for i, t in enumerate(texts)], "text string, lang string")
    want = Counter()
    for i, t in enumerate(texts):
        words = t.split()
        want.update(((["en", "d\te\n", None][i % 3] if group else None), n, " ".join(words[j : j + n])) for n in range(1, 6) for j in range(len(words) - n + 1))
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("rows for each n-gram on the driver"))
    got = {(r[group] if group else None, r.n, r.ngram): r.cnt for r in ngrams.ngram_counts(docs, group=group).collect()}
    assert got == {k: c for k, c in want.items() if c >= 5}


@pytest.mark.parametrize("most", [3, 1000])
def test_any_number_of_compounds_is_joined(spark, most):
    texts = _texts(40, 9)
    docs = spark.createDataFrame([*enumerate(texts), (40, None)], "doc_id long, text string")
    counts = spark.createDataFrame([(3, "a b c", 30), (2, "a b", 30), (2, "d e", 20), (4, "f g h é", 20), (2, "h h", 19), (2, "é a", 20), (3, "g g g", 99)], "n long, ngram string, cnt long")
    compounds = {"a b c", "a b", "d e", "f g h é", "é a", "g g g"}
    lengths = {"a": (2, 3), "d": (2, 2), "f": (4, 4), "é": (2, 2), "g": (3, 3)}
    synonyms = {"c": "d", "a_b": "ab"}
    got = {r.doc_id: (r.n_compounds, r.text) for r in ngrams.compound_tokenize(docs, counts, synonyms=synonyms, most=most).collect()}
    for i, t in enumerate([*texts, ""]):
        made = ngrams.join_compounds(t.split(), frozenset(compounds), lengths, synonyms)
        assert got[i] == (sum("_" in w for w in made), " ".join(made))


def test_an_index_is_searched_without_shuffling_postings(spark, tmp_path):
    docs = spark.createDataFrame([*enumerate(_texts(30, 3)), (30, None), (None, "a b")], "doc_id long, text string")
    asked = docs.filter("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id")
    lexical.save_index(docs, str(tmp_path))
    found = lexical.search_index(spark, str(tmp_path), asked)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lexical.bm25(docs, asked).collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_clusters_measure_what_they_stored(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} a b c d e f g h") for i in range(50)], "doc_id long, text string")
    linked, plans = dedup.components, []

    def spy(edges):
        # 20,000 rows of 24 bytes in files of a few kilobytes
        rows = store(spark.range(20_000, numPartitions=1).selectExpr("id % 2000 AS a", "id % 7 AS b"))
        joined = rows.join(rows.toDF("a", "c"), "a").filter("b < c").select("b", "c").distinct()
        joined.collect()
        plans.append(joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return linked(edges)

    monkeypatch.setattr(dedup, "components", spy)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "200k")
    try:
        assert dedup.dup_clusters(docs).count() == 50
        assert spark.conf.get(key) == "200k"
    finally:
        spark.conf.set(key, before)
    assert plans and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


@pytest.mark.parametrize("sizes", [(4096, 2_000_000, 2**19, 16, 1024), (4096, 2_000_000, 7, 2, 3), (5, 40, 64, 1, 0)])
def test_thousands_of_queries_take_one_pass(spark, monkeypatch, tmp_path, sizes):
    rng = random.Random(4)
    words = [f"w{int(40 * rng.random() ** 3)}" for _ in range(1500)]
    texts = ["the " + " ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(700)]
    for name, value in zip(("BLOCK", "TERMS", "CELLS", "OFTEN", "DENSE"), sizes, strict=True):
        monkeypatch.setattr(lexical, name, value, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts[:60])), "doc_id long, text string")
    asks = list(enumerate(texts if sizes[0] > 5 else texts[:12])) + [(3, texts[4])]
    asked = spark.createDataFrame(asks, "query_id long, text string")
    lexical.save_index(docs, str(tmp_path))
    found = lexical.search_index(spark, str(tmp_path), asked, 5, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sizes[0] == 5 or plan.count("MapInArrow") == 1
    tf = {i: Counter(x.split()) for i, x in enumerate(texts[:60])}
    df, average = Counter(w for c in tf.values() for w in c), sum(sum(c.values()) for c in tf.values()) / 60
    queries, want = {}, set()
    for q, x in asks:
        queries.setdefault(q, set()).update(x.split())
    for q, terms in queries.items():
        scores = []
        for i, c in tf.items():
            met = [math.log(1 + (60.5 - df[w]) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)) for w in terms if c[w]]
            if met and i != q:  # "the" is in all texts: its score alone, 0.01 or so, is one
                scores.append((-round(sum(met), 2), i))
        want |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:5], 1)}
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect()} == want


def test_a_hit_whose_score_rounds_to_nothing_is_one(spark):
    docs = spark.createDataFrame([(i, "the") for i in range(30)], "doc_id long, text string")
    found = lexical.bm25(docs, spark.createDataFrame([(7, "the")], "query_id long, text string"), 3, 1)
    assert sorted(map(tuple, found.collect())) == [(7, 0, 0.0, 1), (7, 1, 0.0, 2), (7, 2, 0.0, 3)]
