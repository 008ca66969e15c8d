"""Sources, personal data, page elements, spans, vectors and streaming on small fixtures."""

import gzip
import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import language_model, pages, personal, spans, vectors
from corpusmill.sources import archives
from corpusmill.streaming import incremental


def _tags(text):
    return [(e, t) for e, _, _, t in personal.detect(text)]


def test_personal_data_by_context():
    assert _tags("write to a.b@example.com, or 10.0.0.1.") == [("a.b@example.com", "EMAIL"), ("10.0.0.1", "IP_ADDRESS")]
    assert _tags("she was born 1980 here") == [("1980", "AGE")]
    assert _tags("it was 1980 here") == []
    assert _tags("born 1980-02-03 here") == [("1980-02-03", "AGE")]
    assert _tags("see pp. 123456789 there") == []
    assert _tags("card 4111 1111 1111 1111 ok") == [("4111 1111 1111 1111", "ID")]
    assert _tags("x" * 101) == [] and personal.detect(None) == [] and personal.detect("") == []
    text = "a 10.0.0.1 b"
    assert [text[s:e] for _, s, e, _ in personal.detect(text)] == ["10.0.0.1"]
    assert personal.id_kind("DE89 3704 0044 0532 0130 00") == "iban" and personal.id_kind("4111111111111112") is None


def test_redaction_equals_the_offsets(spark):
    df = spark.createDataFrame([(1, "é a.b@example.com und 10.0.0.1"), (2, ""), (3, None)], "doc_id long, text string")
    made = df.join(personal.entities(df), "doc_id").select("doc_id", personal.redact(F.col("text"), F.col("ents")).alias("r"))
    assert {r.doc_id: r.r for r in made.collect()} == {1: "é [EMAIL] und [IP_ADDRESS]", 2: "", 3: None}


def test_elements_of_a_page():
    html = """<html><head><title>A &amp; B</title><meta name="k" content="v"><script>var x = "<p>";</script></head><body>
    <nav><ul><li>One</li><li>Two</li></ul></nav><img src="/a.png" width="50"><img src="/b.png" width=200 alt="cat">
    <iframe src="f.html"></iframe><video><source src="v.mp4"></video><code>x = 1</code><a href="/p">Privacy policy</a><a href="/q">other</a>
    <form><input name="a" value="1"><input name="b" type="hidden" value="2"><input name="c"></form>
    <table><tr><td>1<table><tr><td>in</td><td>2</td></tr><tr><td>3</td></tr></table></td></tr></table><details>more"""
    found = pages.elements(html, "http://e.org/d/")
    assert found == [
        ("title", 0, "A & B"), ("meta", 0, "k: v"), ("nav", 0, "One | Two"), ("img", 0, "http://e.org/b.png [cat]"),
        ("iframe", 0, "http://e.org/d/f.html"), ("video", 0, "http://e.org/d/v.mp4"), ("code", 0, "x = 1"),
        ("rights_link", 0, "Privacy policy:http://e.org/p"), ("inputs", 0, "a:1; b; c:"), ("table", 0, "in | 2\n3"), ("summary", 0, "more"),
    ]
    assert pages.elements(None, None) == [] and pages.elements("plain", "x") == []


def test_page_text_with_marks(spark):
    html = """<head><title>Big News</title><meta name=a content=b></head><body><h1>Big News</h1><nav>Home</nav><p>First part</p><p>Done.</p><img src=/x.png alt=pic>
    <table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr><tr><td>5</td><td>6</td></tr></table><map><area alt=North href=/n></map></body>"""
    rows = [(1, "http://e.org/", html), (2, "http://e.org/", "<p>only text</p>"), (3, None, None), (4, "u", "<nav>only nav</nav>")]
    made = pages.page_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in made.collect()}
    assert got[1].title == "Big News" and got[1].meta == "a: b" and got[1].reason is None
    assert got[1].text == "###title###0###. ###nav###0### First part. Done. ###img###0### ###table###0### ###area###0###"
    assert [(e["kind"], e["val"]) for e in got[1].elements][-2:] == [("table", "a | b\n---\n1 | 2\n3 | 4\n5 | 6"), ("area", "North:http://e.org/n")]
    assert (got[2].reason, got[3].reason, got[4].reason) == ("no element", "no element", "no text") and got[2].text == "only text."
    places = {r.element_id: (r.position, r.rel_position) for r in pages.positions(made.filter("page_id = 1")).collect()}
    assert places["###title###0###"] == (0, 0.0) and places["###nav###0###"][0] == got[1].text.index("###nav") and "###meta###0###" not in places


def test_lines_and_spans(spark):
    df = spark.createDataFrame([(1, "ab\n\ncd"), (2, ""), (3, None), (4, "One two. Three four! Five")], "doc_id long, text string")
    assert sorted(tuple(r) for r in spans.lines(df.filter("doc_id < 4")).collect()) == [(1, 0, 0, 0.0, "ab"), (1, 2, 4, round(4 / 6, 6), "cd")]
    assert sorted(tuple(r) for r in spans.consolidate(df.filter("doc_id > 1"), 10).collect()) == [(4, 0, 0, "One two. Three four!"), (4, 1, 20, "Five")]


def test_perplexity_by_hand(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "a"), (3, None)], "doc_id long, text string")
    # pairs ab 2, ba 1; firsts a 2, b 1; two first words
    want = round(float(np.exp(-(2 * np.log(3 / 4) + np.log(2 / 3)) / 3)), 2)
    assert [tuple(r) for r in language_model.perplexity(df).collect()] == [(1, want)]


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60, [0.0] * 6), (61, None)]
    rows.append((62, rows[0][1]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r["rank"]): (r.nn_id, r.score) for r in vectors.cosine_topk(df.filter("vec_id % 10 = 0"), df, 3).collect()}
    known = [(i, vectors._unit([v])[0]) for i, v in rows if v is not None]
    for q, v in known:
        if q % 10 == 0:
            best = sorted(((-round(float(v @ w), 4) + 0.0, i) for i, w in known if i != q))[:3]
            assert [got[q, r] for r in (1, 2, 3)] == [(i, -s + 0.0) for s, i in best]


def test_tree_holds_every_row_and_finds_neighbours(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 6]]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    tree = vectors.cluster_tree(df, leaf=20)
    assert sorted(r.child for r in tree.filter("level = 0").collect()) == list(range(120))
    found = vectors.tree_search(tree, df.filter("vec_id % 10 = 0"), k=3).collect()
    assert len(found) == 36 and all(r.vec_id % 6 == r.nn_id % 6 for r in found)


def test_tree_search_finds_what_lies_off_its_route(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0")
    found = vectors.tree_search(vectors.cluster_tree(df, leaf=10), asked, width=1)
    assert sorted(map(tuple, found.select("vec_id", "rank", "nn_id", "score").collect())) == sorted(map(tuple, vectors.cosine_topk(asked, df).select("vec_id", "rank", "nn_id", "score").collect()))


def test_web_archive_records(spark, tmp_path):
    def record(kind, url, body, http="HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"):
        block = http + body
        head = f"WARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
        return gzip.compress(f"WARC/1.0\r\n{head}{block}\r\n\r\n".encode())

    page = "<p>" + "word " * 40 + "</p>\r\n\r\n<p>end</p>"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(record("response", "http://e.org/1", page) + record("response", "http://e.org/2", "x") + record("metadata", "u", page))
    rows = archives.read_warc(spark, str(path)).withColumn("reason", archives.reject_reason()).collect()
    assert [(r.url, r.reason) for r in rows] == [("http://e.org/1", None), ("http://e.org/2", "short"), ("u", "metadata")]
    assert rows[0].payload == page and rows[0].content_type == "text/html"


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"text": "one"}\n{"other": "two"}\nplain\n')
    assert [r.text for r in archives.read_jsonl(spark, str(path), "text", "other").collect()] == ["one", "two", "plain"]


def test_streamed_cutoffs_equal_a_rolling_frame(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b"]), round(rng.random(), 3)) for i in range(60)]
    for n in range(3):  # three micro-batches
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], "doc_id long, lang string, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("doc_id long, lang string, score double").parquet(str(tmp_path / "s"))
    got = {r.doc_id: r.cutoff for r in incremental.run_available(incremental.moving_cutoffs(stream, 5), "cut").collect()}
    assert len(got) == 60
    for lang in "ab":
        own = [r for r in rows if r[1] == lang]
        for k, r in enumerate(own[1:], 1):
            frame = np.array([s for _, _, s in own[max(0, k - 4) : k + 1]])
            assert abs(got[r[0]] - (frame.mean() - 2 * frame.std(ddof=1))) < 2e-6


def test_streamed_sessions_keep_files_out_of_time_order(spark, tmp_path, monkeypatch):
    from functools import partial

    from corpusmill.plans import search

    for day in (9, 1, 5, 3):  # four micro-batches; the last two events of a day are one session
        rows = [(u, f"2024-01-0{day} {at}:00") for u in (1, 2) for at in ("01:00", "05:00", "05:10")]
        made = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(incremental, "stream_table", partial(incremental.stream_table, files_a_batch=1))
    got = sorted((r.user_id, r.session_start.day, r.n) for r in search.stream_sessions(spark, str(tmp_path)).collect())
    assert got == sorted((u, d, n) for u in (1, 2) for d in (1, 3, 5, 9) for n in (1, 2))
