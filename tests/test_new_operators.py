"""N-grams, lexical search, vectors, sinks, spans and personal data against brute force and values worked out by hand."""

import gzip
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import embed, lexical, ngrams, personal, spans, vectors
from corpusmill.operators import text as X
from corpusmill.sources import archives, sinks


def _texts(n, seed=4, size=30):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("most_bytes", [ngrams.MOST_HASHES, 0])
def test_ngram_counts_equal_brute_force(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(ngrams, "MOST_HASHES", most_bytes)
    monkeypatch.setattr(ngrams, "HELD", 50)
    texts = _texts(40)
    docs = spark.createDataFrame([*((i, t, "xy"[i % 2]) for i, t in enumerate(texts)), (98, None, None), (99, "", "x")], "doc_id long, text string, lang string")
    want = Counter(" ".join(t.split()[i : i + n]) for t in texts for n in range(1, 6) for i in range(len(t.split()) - n + 1))
    got = {r.ngram: (r.n, r.cnt) for r in ngrams.ngram_counts(docs).collect()}
    assert got == {g: (len(g.split()), c) for g, c in want.items() if c >= 5}
    by_lang = Counter(("xy"[k % 2], w) for k, t in enumerate(texts) for w in t.split())
    assert {(r.lang, r.ngram): r.cnt for r in ngrams.ngram_counts(docs, most=1, group="lang").collect()} == {k: c for k, c in by_lang.items() if c >= 5}
    assert ngrams.ngram_counts(docs.limit(0)).count() == 0


def test_compounds_are_joined_longest_first(spark):
    lengths = {"a": (2, 3), "b": (2, 2)}
    assert ngrams.join_compounds("a b c a b b c".split(), frozenset({"a b c", "a b", "b c"}), lengths) == ["a_b_c", "a_b", "b_c"]
    assert ngrams.join_compounds("x a b".split(), frozenset({"a b"}), lengths, {"x": "a", "a_b": "ab"}) == ["a", "ab"]
    counts = spark.createDataFrame([(2, "a b", 30), (3, "a b c", 20), (2, "c d", 5), (1, "a", 99)], "n long, ngram string, cnt long")
    docs = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngrams.compound_tokenize(docs, counts).collect()) == [(1, 1, "a_b_c d"), (2, 0, ""), (3, 0, "")]
    assert [tuple(r) for r in ngrams.compound_lengths(counts).collect()] == [("a", 2, 3)]
    tokens = spark.createDataFrame([("Ab", 2.0, 1), ("ab", 1.0, 1), ("ac", 1.0, 1), ("x", 9.0, 2)], "token string, weight double, cluster int")
    assert {tuple(r) for r in ngrams.synonym_parents(tokens).collect()} == {("Ab", "Ab"), ("ab", "ab"), ("ac", "ab"), ("x", "x")}


def test_bm25_equals_brute_force_and_the_index(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lexical, "BLOCK", 2)
    texts = _texts(30, seed=9, size=12)
    rows = [*enumerate(texts), (100, None), (101, ""), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(0, texts[0]), (1, "a a zz"), (5, texts[5]), (7, ""), (8, None), (None, "a")], "query_id long, text string")
    tf = {i: Counter(t.lower().split()) for i, t in rows if i is not None and t and t.split()}
    average, n = sum(sum(c.values()) for c in tf.values()) / len(tf), len(tf)
    df = Counter(w for c in tf.values() for w in c)
    want = set()
    for q, text in ((0, texts[0]), (1, "a a zz"), (5, texts[5])):
        scores = {}
        for i, c in tf.items():
            met = [w for w in set(text.split()) if c[w]]
            if met and i != q:
                scores[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)) for w in met), 4)
        want |= {(q, i, s, r) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:4], 1)}
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in lexical.bm25(docs, asked, 4).collect()} == want
    lexical.save_index(docs, str(tmp_path / "index"), buckets=3)
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in lexical.search_index(spark, str(tmp_path / "index"), asked, 4).collect()} == want
    assert lexical.bm25(docs.limit(0), asked).count() == 0 and lexical.bm25(docs, asked.limit(0)).count() == 0


def test_best_keeps_ties_by_the_lower_id():
    best = lexical.Best(1, 2)
    best.add(np.array([5, 3, 9]), np.array([[1.0, 1.0, 1.0]]))
    best.add(np.array([1]), np.array([[1.0]]), 0.0)
    assert best.ids[0].tolist() == [1, 3]


def test_vector_forms(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0], [3.0, 4.0])], "vec_id long, tokens array<array<double>>, mask array<double>, x array<double>")
    row = df.select(vectors.mean_pooling(F.col("tokens"), F.col("mask")).alias("m"), vectors.softmax(F.col("x")).alias("s"), vectors.normalised(F.col("x")).alias("n"), vectors.temperature_mix(F.col("x")).alias("t")).first()
    soft = np.exp([3, 4]) / np.exp([3, 4]).sum()
    assert row.m == [2.0, 3.0] and np.allclose(row.s, soft) and np.allclose(row.n, [0.6, 0.8]) and np.allclose(row.t, (2 * soft + [0.6, 0.8]) / 3)
    clusters = spark.createDataFrame([(i, i % 2) for i in range(8)], "vec_id long, c long")
    known = spark.createDataFrame([(0, 70), (2, 70), (4, 71), (1, 50)], "vec_id long, label long")
    assert {r.vec_id: r.label for r in vectors.merge_labels(clusters, known).collect()} == {0: 70, 2: 70, 4: 71, 6: 70, 1: 50, 3: 3, 5: 3, 7: 3}


def test_roots_of_a_forest_and_of_a_cycle(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)] + [("x", "y")], "child string, parent string")
    assert {r.child: (r.root, r.depth) for r in vectors.roots(edges).collect()} == {**{str(i): ("9", 9 - i) for i in range(9)}, "x": ("y", 1)}


def test_embedder_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "ab c"), (2, ""), (3, None)], "doc_id long, text string")
    made = {r.doc_id: r.embedding for r in embed.embed(docs, lambda: lambda t: [float(len(t))]).collect()}
    assert made == {1: [4.0], 2: None, 3: None}
    hashed = {r.doc_id: r.embedding for r in embed.embed(docs, embed.hashing(8)).collect()}
    assert sum(map(abs, hashed[1])) in (0, 2) and hashed[2] is None


def test_sinks_give_back_what_they_got(spark, tmp_path):
    texts = ["a\nb", "back\\slash \\n", "cr\r\n", "", "plain", "\\\\n\n"]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    sinks.write_lines(docs, str(tmp_path / "lines"))
    assert sorted(r.text for r in sinks.read_escaped(spark, str(tmp_path / "lines")).collect()) == sorted(texts)
    sinks.write_records(docs, str(tmp_path / "records"), compress=True)
    assert sorted(map(tuple, sinks.read_records(spark, str(tmp_path / "records"), docs.schema).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    sinks.write_counters(docs, ["text"], str(tmp_path / "counters"))
    assert sum(r.n for r in sinks.read_records(spark, str(tmp_path / "counters"), "text string, n long").collect()) == 7
    rows = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<double>")
    sinks.write_vectors(rows, str(tmp_path / "vectors"))
    assert [r.vec_id for r in sinks.read_vectors(spark, str(tmp_path / "vectors")).collect()] == [1]
    assert [r.vec_id for r in sinks.read_vectors(spark, str(tmp_path / "vectors"), skipped=True).collect()] == [2]
    sinks.write_pages(spark.createDataFrame([(7, "<p>x</p>"), (8, None)], "page_id long, html string"), str(tmp_path / "pages"))
    assert [p.parent.name for p in (tmp_path / "pages").glob("*/*.txt")] == ["key=7"]


def test_numbered_lines_have_byte_offsets(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é\nbc\n\nd\n", encoding="utf-8")
    with gzip.open(tmp_path / "b.gz", "wt") as file:
        file.write("x\ny\n")
    plain = archives.numbered_lines(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()
    assert [(r.line_no, r.offset, r.text) for r in plain] == [(0, 0, "é"), (1, 3, "bc"), (2, 6, ""), (3, 7, "d")]
    assert [(r.line_no, r.offset, r.text) for r in archives.numbered_lines(spark, str(tmp_path / "b.gz")).collect()] == [(0, 0, "x"), (1, 2, "y")]


def test_lines_with_escapes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\\ntwo\nthree\n")
    assert sorted(r.text for r in archives.read_lines(spark, str(tmp_path / "a.txt")).collect()) == ["one\ntwo", "three"]


def test_binary_payloads_stay_whole(spark, tmp_path):
    pdf = bytes(range(256)) + b"WARC/1.0 inside"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: application/pdf\r\n\r\n" + pdf
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://e.org/x\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record + other))
    got = [(r.warc_type, r.content_type, r.length, bytes(r.payload)) for r in archives.read_warc_binary(spark, str(tmp_path / "a.warc.gz")).collect()]
    assert got == [("response", "application/pdf", len(body), pdf), ("metadata", "", 2, b"ab")]


def test_short_lines_and_spans(spark):
    df = spark.createDataFrame([(1, "Short\nA line that is long enough.\nEnd"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in spans.merge_short(df).collect()] == [(1, 1, "Short A line that is long enough."), (1, 2, "End")]
    text = "One two. Three four! Five six? " * 30 + "x" * 500
    for size in (10, 50, 200):
        made = spans.consolidate(spark.createDataFrame([(1, text)], "doc_id long, text string"), size).orderBy("span_no").collect()
        assert "".join(r.span.replace(" ", "") for r in made) == text.replace(" ", "")
        assert all(len(r.span) <= 2 * size + 1 for r in made) and [r.span_no for r in made] == list(range(len(made)))
    assert _prefix(spark, "section", "Intro", None) == "section: Intro || " and _prefix(spark, "intro", "A", "01/02/20") == "intro: date of 01/02/20; A || "


def _prefix(spark, *values):
    row = spark.createDataFrame([values], "p string, l string, d string")
    return row.select(spans.dated_prefix(F.col("p"), F.col("l"), F.col("d"))).first()[0]


def test_entities_by_the_names_of_their_kinds():
    text = "Ann met Bob, Carl and Ann in Rome."
    ents = [("Ann", 0, 3, "PERSON"), ("Bob", 8, 11, "PERSON"), ("Carl", 13, 17, "PERSON"), ("Ann", 22, 25, "PERSON"), ("Rome", 29, 33, "GPE")]
    assert spans.generalized(text, ents) == "The Person 1 met The Person 2, The Person 3 and The Person 1 in The Location."
    assert spans.generalized("Ann and Acme Inc", [("Ann", 0, 3, "PERSON"), ("Acme Inc", 8, 16, "X")]) == "The Person and Acme_Inc"
    assert spans.generalized("The Person and The Person, The Person", []) == "The Person"


def test_ocr_choice_by_hand(spark):
    boxes = [("a", 0, i, 1.0, 1.0, "low words here", 0.5) for i in range(3)] + [("a", 1, 0, 1.0, 1.0, "the better reader", 0.8), ("a", 1, 1, 100.0, 100.0, "far away", 0.9), ("a", 1, 2, 1.0, 1.0, "noise", 0.1)]
    boxes += [("b", 0, 0, 1.0, 1.0, "12345678901234567890 a", 0.9), ("c", 0, 0, 1.0, 1.0, "only a weak reading of it", 0.4), ("d", 0, 0, 1.0, 1.0, "short", 0.9)]
    df = spark.createDataFrame(boxes, "image string, reader int, ord long, x double, y double, text string, prob double")
    got = {r.image: (r.reader, r.score, r.text) for r in spans.ocr_choice(df).collect()}
    assert got == {"a": (1, 0.85, "the better reader far away."), "c": (0, 0.4, "only a weak reading of it.")}


def _tags(text, **options):
    return [(e, t) for e, _, _, t in personal.detect(text, **options)]


def test_personal_data_of_more_kinds(spark):
    assert _tags("我的电话是13812345678。") == [("13812345678", "PHONE")]
    assert _tags("他今年25岁了") == [("25岁", "AGE")]
    assert _tags("x" * 60 + "漢" + "y" * 60 + " a.b@example.com") == [("a.b@example.com", "EMAIL")]
    assert _tags("文" * 150 + "a.b@example.com" + "文" * 30) == [("a.b@example.com", "EMAIL")]
    assert _tags('{"mail":"a.b@example.com","list":[' + "1," * 80 + "2]}")[0] == ("a.b@example.com", "EMAIL")
    assert _tags("x" * 101) == []
    assert _tags("the car with plate AB 123 CD left") == [("AB 123 CD", "LICENSE_PLATE")] and _tags("the word AB 123 CD left") == []
    assert _tags("at ::1 and fe80::1:2 ok") == [("::1", "IP_ADDRESS"), ("fe80::1:2", "IP_ADDRESS")]
    assert _tags("so 12 + 30 = 42 here") == [("12 + 30 = 42", "EQUATION")]
    assert _tags("book 978-3-16-148410-0 ok") == [] and personal.id_kind("0-306-40615-2") == "isbn"
    assert _tags("from 1990-1995 on") == [("1990-1995", "DATE")] and _tags("on 2004-05-06 it") == [("2004-05-06", "DATE")]
    assert personal.id_kind("11010519491231002X") == "resident"
    assert _tags("born 1980-02-03, card 4111 1111 1111 1111", tags=("ID",)) == [("4111 1111 1111 1111", "ID")]
    assert [personal.fast_date(x) for x in ("2020-05", "1990/1995", "3.4.2001", "2020-13", "12-34", "123456")] == [True, True, True, False, False, False]
    docs = spark.createDataFrame([(1, "a.b@example.com 10.0.0.1 10.0.0.2"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: (r.email_cnt, r.ip_address_cnt, r.id_cnt) for r in personal.entity_counts(docs).collect()} == {1: (1, 2, 0), 2: (0, 0, 0)}


def test_language_rules(spark):
    cases = [
        (("de", 0.4, "de", 0.0, 0.0, None), ("de", 0.6)),  # unsure, same group: raised
        (("de", 0.6, "xx", 0.0, 0.0, None), ("de", 0.6)),  # sure enough
        (("de", 0.3, "xx", 0.25, 0.0, None), ("de", 0.55)),  # the stop words of the first language that has enough
        (("en", 0.3, "xx", 0.0, 0.3, None), ("en", 0.6)),
        (("en", 0.2, "xx", 0.0, 0.0, "ja"), ("ja", 0.8)),  # the script decides
        (("de", 0.35, "xx", 0.3, 0.0, None), ("de", 0.525)),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, first string, score double, second string, s_de double, s_en double, script string")
    made = df.select("i", *X.lang_rules("first", "score", "second", {"de": "s_de", "en": "s_en"}, "script")).collect()
    assert {r.i: (r.lang_id, r.score) for r in made} == {i: w for i, (_, w) in enumerate(cases)}


def test_a_cluster_without_a_shared_folder_is_an_error():
    from corpusmill import session

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="checkpoint"):
        session._shared_folder(type("Spark", (), {"sparkContext": Context()})())


def test_broadcasts_are_bounded_by_bytes(spark):
    from corpusmill.session import broadcast_if_small

    rows = spark.createDataFrame([(i, "x" * 1000) for i in range(100)], "i long, t string")
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().logical().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hint(broadcast_if_small(rows, 200_000)) and not hint(broadcast_if_small(rows, 50_000)) and hint(broadcast_if_small(rows.select("i"), 50_000))


def test_held_levels_equal_a_fold(spark, monkeypatch):
    from corpusmill.operators import windows

    monkeypatch.setattr(windows, "BUCKET", 4)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0, 1, 1, 1, 2])) for i in range(90)]
    got = {r.i: r.held for r in windows.held_levels(spark.createDataFrame(rows, "i long, k string, level long"), "k", "i", "level").collect()}
    last = {}
    for i, k, level in rows:
        if level != 1:
            last[k] = level
        assert got[i] == (2 if level == 1 and last.get(k) == 2 else level)


def test_stored_folders_are_released(spark):
    import os

    from corpusmill import session

    session._stored.clear()
    session.store(spark.range(3))
    path = session._stored[0].removeprefix("file:")
    assert os.path.isdir(path) and session.release(spark) == 1 and not os.path.exists(path)


def test_streams_keep_levels_and_counts(spark, tmp_path):
    from corpusmill.streaming import incremental

    rows = [(i, "ab"[i % 2], float((i * 7) % 11)) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "i long, k string, v double").coalesce(1).write.parquet(f"{tmp_path}/t.parquet/p{part}")
    stream = lambda: spark.readStream.schema("i long, k string, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t.parquet/*")
    made = {r.i: r.level for r in incremental.run_available(incremental.feature_levels(stream(), "k", "i", "v", window=5), "levels").collect()}
    assert set(made) == set(range(60)) and set(made.values()) <= {0, 1, 2}
    incremental.running_counts(stream(), ["k"], str(tmp_path / "counts")).awaitTermination()
    assert {r.k: r.n for r in spark.read.json(str(tmp_path / "counts")).collect()} == {"a": 30, "b": 30}
    means, sds = incremental.rolling([1.0, 2.0], np.array([3.0, 10.0]), 3)
    assert np.allclose(means, [2.0, 5.0]) and np.allclose(sds, [1.0, np.std([2, 3, 10], ddof=1)])
