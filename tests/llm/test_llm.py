"""The ten operators on small fixtures: brute force, edge cases, clashing columns."""

import random
import re

import pytest

from corpusmill.llm import decontaminate, html_extract, language_id, license_scan, mixing, near_dedup, quality_classifier, quality_rules, token_count, url_filter

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, texts):
    """Documents with a clashing extra column, a null, an empty text and a repeated row."""
    rows = [(i, t, f"s{i % 2}", "x", "y") for i, t in enumerate([*texts, None, "", " \n "])]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, kept string, score string")


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, kept string, score string")


def _texts(n, seed=5, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(words)] for _ in range(n // 4)]
    out = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2, 4):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            out.append(" ".join(c))
    return out


def test_near_duplicates_equal_brute_force(spark):
    docs = _docs(spark, _texts(80))
    rows = {r.doc_id: r.text for r in docs.collect()}

    def shingles(text):
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}

    sets, parent = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = near_dedup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), find(i), find(i) == i) for i in rows}
    assert len(got) == docs.count()
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    empty = {i for i in rows if not sets[i]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in rows} | empty)
    assert near_dedup.near_duplicates(_empty(spark)).count() == 0


def test_pipeline_compares_shingles_of_five_words(spark):
    import corpus_pipeline

    # two words replaced far apart: of 76 and 75 shingles 8 and 10 differ on each side
    words = [f"w{i}" for i in range(79)]
    other = [*words[:20], "x", *words[21:50], "y", *words[51:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words))], "doc_id long, text string")
    assert 100 * 68 >= 80 * (2 * 76 - 68) and 100 * 65 < 80 * (2 * 75 - 65)
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == [1]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [1, 2]


def test_signature_keys_meet_the_guarantee():
    import numpy as np

    rng = np.random.RandomState(1)
    a = rng.randint(0, 65536, (200, near_dedup.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.POSITIONS, near_dedup.GUARANTEED, replace=False)] ^= 1
    assert ((near_dedup.keys_of(a) == near_dedup.keys_of(b)).any(axis=1)).all()


@pytest.mark.parametrize("most", [200_000, 0])
def test_benchmark_windows_equal_brute_force(spark, most):
    texts = _texts(24, words=40)
    items = [" ".join(texts[0].split()[3:25]), " ".join(texts[1].split()[:12]).upper(), texts[2].split()[5] + " " + texts[2].split()[6], "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = _docs(spark, texts)

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    windows = {}
    for i, t in enumerate(items):
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = {}
    for r in docs.collect():
        w, hit, found = words(r.text), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= ids
        want[r.doc_id] = (len(w), len(hit), sorted(found), bool(hit))
    prepared = decontaminate.prepare(bench, most=most)
    got = decontaminate.matches(docs, prepared).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == want
    assert len(got) == docs.count()
    clean = decontaminate.clean(docs, prepared)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[3]}


def test_token_counts_equal_a_plain_dynamic_programme():
    pieces = {"▁a": -1.0, "▁": -2.0, "a": -1.5, "b": -2.0, "ab": -3.5, "▁ab": -3.0, "ba": -3.0}
    counter = token_count.Counter(pieces, True)

    def plain(text):
        s = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [None] * len(s)
        for i in range(len(s)):
            options = [(p, v, 1) for p, v in pieces.items() if s.startswith(p, i)]
            if s[i] not in pieces:
                options.append((s[i], min(pieces.values()) - 10, len(s[i].encode())))
            for p, v, n in options:
                j = i + len(p)
                if best[j] is None or best[i][0] + v > best[j][0]:
                    best[j] = (best[i][0] + v, best[i][1] + n)
        return best[-1][1]

    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("ab é\n", k=rng.randint(1, 12)))
        assert counter.text(text) == plain(text), text
    assert counter.text(None) == counter.text("") == 0


def _message(number, body):
    size, head = len(body), bytes([number << 3 | 2])
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return head + bytes([size]) + body


def _as_unigram(path, keep=lambda piece: True, fallback=True):
    """The library's encoder over the file read as a unigram model, of the pieces that ``keep`` takes."""
    sentencepiece = pytest.importorskip("sentencepiece")
    out = b""
    for number, value in token_count._fields(open(path, "rb").read()):
        if number == 2:
            assert dict(token_count._fields(value))[3] == 2
            value = value.replace(b"\x18\x02", b"\x18\x01", 1)
            if not fallback:
                value = value.replace(b"\x98\x02\x01", b"\x98\x02\x00", 1)
        if number != 1 or keep(dict(token_count._fields(value))):
            out += _message(number, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out), out


def test_token_counts_agree_with_the_library(tmp_path):
    encoder, _ = _as_unigram(VOCABULARY)
    pieces, fallback = token_count.read_vocabulary(VOCABULARY)
    counter = token_count.Counter(pieces, fallback)
    assert counter.mark is not None
    words = [p.lstrip("▁") for p in pieces][::3]
    rng = random.Random(6)
    long = ["".join(rng.choices([w for w in words if w.isalpha()], k=k)) + " the and have cont theme" for k in (5, 50, 500)]
    odd = ["", " ", "  ", "a\nb", "\n", "\n\n the", " the", "the  and ", "x\u2028 the", "日本語 the", "▁ the", "\x00 and", "a\tthe", "the\n  the"]
    mixed = [" ".join(rng.choices([*words, "the", "and", "have", "\n", "\nthe"], k=rng.randint(1, 300))) for _ in range(200)]
    texts = [*words, *long, *odd, *mixed]
    assert [counter.text(t) for t in texts] == [len(encoder.encode(t)) for t in texts]
    # the words seen change no count
    assert [counter.text(t) for t in mixed] == [token_count.Counter(pieces, fallback).text(t) for t in mixed[:5]] + [len(encoder.encode(t)) for t in mixed[5:]]


def test_token_counts_without_byte_fallback_join_runs_of_unknown_characters(tmp_path):
    encoder, raw = _as_unigram(VOCABULARY, lambda piece: piece.get(3, 1) != token_count.BYTE, fallback=False)
    path = tmp_path / "some.model"
    path.write_bytes(raw)
    pieces, fallback = token_count.read_vocabulary(str(path))
    assert not fallback
    counter = token_count.Counter(pieces, fallback)
    texts = ["a\n\n\nb", "\n\n", "\x01\x02 the", "the\n", "x\u2028\u2029y \x01", "\n \n", "ᚠᚢᚦ\nᚠ"]
    assert [counter.text(t) for t in texts] == [len(encoder.encode(t)) for t in texts]


def test_suffix_automaton_parses_by_longest_match():
    automaton = language_id.SuffixAutomaton()
    text = "abracadabra"
    automaton.add(text)
    rng = random.Random(4)
    for _ in range(200):
        s, n, i = "".join(rng.choices("abrcdz", k=12)), 0, 0
        while i < len(s):
            k = 1
            while i + k < len(s) and s[i : i + k + 1] in text:
                k += 1
            n, i = n + 1, i + k
        assert automaton.phrases(s) == n


def test_language_id_edges(spark):
    sample = {"en": ["the", "house", "with"], "de": ["das", "haus", "mit"]}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(_docs(spark, ["the house", "das haus mit", "12 34"]), sample).collect()}
    assert got[0][0] == "en" and got[1][0] == "de"
    assert got[2] == got[3] == got[4] == ("und", 0.0)
    assert language_id.language_id(_empty(spark), {}).count() == 0


def test_html_blocks_and_cut():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/a>Home</a></nav><div class="ad">Buy this now.</div>
    <article><h1>Title &amp; more</h1><p>First  paragraph<br>goes on.<p>Second <b>one</b>.</p><div class="comments"><p>Nice post!</p></div></article>
    <form>Your mail</form><footer>&copy; me</footer><scr"""
    assert html_extract.main_text(page) == "Title & more\nFirst paragraph goes on.\nSecond one."
    assert html_extract.main_text(None) == html_extract.main_text("") == ""


def test_min_cut_equals_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(1, 7)
        scores = [round(rng.uniform(-2, 2), 2) for _ in range(n)]
        edges = [(a, b, round(rng.random(), 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(labels):
            return sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert abs(cost(html_extract.min_cut(scores, edges)) - best) < 1e-6


def test_quality_rules_base_counts():
    ids, field = quality_rules.WordIds(), quality_rules.train([])
    text = "a b c\na b c\n#x |"
    assert quality_rules.judge(text, ids, field)[:6] == (8, 9, 2, 1, 6, True)
    assert quality_rules.judge(None, ids, field)[:7] == (0, 0, 0, 0, 0, True, False)


def test_viterbi_equals_brute_force():
    field = quality_rules.Field([1.0], [[0.4, -0.3], [-0.2, 0.5]], 0.1)
    rng = random.Random(8)
    for _ in range(50):
        s = [rng.uniform(-1, 1) for _ in range(rng.randint(1, 7))]

        def value(labels):
            return sum(x for x, y in zip(s, labels, strict=True) if y) + 0.1 * labels[0] + sum(field.moves[a][b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(value([m >> i & 1 for i in range(len(s))]) for m in range(2 ** len(s)))
        assert abs(value(field.decode(s)) - best) < 1e-9


def test_quality_classifier_edges(spark):
    model = quality_classifier.fit([("clean prose of some length here " * 5, 1), ("BUY!!! NOW!!! $$$ %%% ###" * 8, 0)] * 30)
    got = {r.doc_id: r.score for r in quality_classifier.score(_docs(spark, ["clean prose of some length here " * 6, "BUY!!! NOW!!! $$$ " * 9]), model).collect()}
    assert got[0] > 0.5 > got[1]
    assert all(0 <= v <= 1 for v in got.values())


def test_mix_draws_every_document_and_meets_the_budget(spark):
    rows = [(i, "a b c d", "big" if i % 10 else "small") for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, None, None), (401, "x y", None)], "doc_id long, text string, source string")
    got = mixing.mix(docs, entropy=1.0, most_repeats=None).collect()
    assert {r.doc_id for r in got} == set(range(402))
    tokens = {}
    for r in got:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
    assert abs(tokens["big"] - tokens["small"]) <= 4 and abs(tokens["big"] - tokens[None]) <= 4
    capped = mixing.mix(docs.filter("source IS NOT NULL"), most_repeats=3.0).groupBy("source", "epoch").count().collect()
    assert max(r.epoch for r in capped) <= 2
    assert mixing.mix(docs.limit(0)).count() == 0


def test_license_scan_prunes_without_loss():
    scanner = license_scan.Scanner()
    assert scanner.text("Prose first.\nLicensed under the Apache License, Version 2.0.") == ("Apache-2.0", 1.0, ["Apache-2.0"])
    assert scanner.text(None) == scanner.text("") == scanner.text("word") == (None, None, [])
    assert scanner.text(license_scan.MIT_GRANT + "\n" + license_scan.MIT_WARRANTY)[0] == "MIT"
    for name, text in license_scan.TEMPLATES:
        assert scanner.text(text)[1] == 1.0, name


def test_url_rules(spark):
    from corpusmill.llm.queries import RULES

    urls = ["http://a.com/en/x", "https://B.example.com/en/7?q", "http://x.example.net/de/81", "http://y.net/de/81", "nothing", None, "http://ads-track.example.fr/a#b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, RULES, url_filter.train(spark)).collect()}
    assert got[0] == ("a.com", "/en/x", "com/en/", "block")
    assert got[1] == ("b.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2][2:] == ("example.net/de/8", "block")
    assert got[3][2:] == ("net/de/", "allow")
    assert got[4][:3] == got[5][:3] == ("", "", None)
    assert got[6] == ("ads-track.example.fr", "/a", None, "block")
