"""Operator 6: quality rules and line labels by a linear-chain conditional random field.

Words are runs of anything but ASCII white space. Base counts of a whole text: words, their code
points, symbols, repeated lines, words in repeated 3-word windows. A text of fewer than 50 words, or
with more than half of its words in repeated windows, fails the base rules.

Each line with a word is a step of a chain with the labels content and boilerplate. Its features are
shares (symbols, capital words, repeated words, separators, letters, digits), length and whether it
ends a sentence or repeats an earlier line. Viterbi decoding gives the most likely labels; a text is
kept if content lines hold at least ``SHARE`` of its words.

The field is trained here by gradient ascent on the chains' likelihood, on a bounded sample:
``docs_per_label`` whole texts of each quality label. Labels of texts are turned into labels of lines: a
good text's lines are content; of a bad text at least half of the words lie in boilerplate lines, and which
lines these are is found in turns with the weights, from the lines that look least like good texts'.
Chains in which both kinds meet are added by setting runs of boilerplate lines into good texts, so
the moves are learned from changes too. Without both labels every line counts as content.

Null or empty text: no words, fails the base rules. A text without line ends is one line, however
long; repeated lines are lines of their own. Ties between labels go to content. An empty table gives
an empty result. Other columns are dropped (``keep_content`` keeps all); repeated rows stay.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.batches import append, fresh, labelled_texts
from corpusmill.session import spread

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
LEAST_WORDS = 50
SHARE = 0.5
FEATURES = 11
_ENDS = (b".", b"!", b"?", b":", b'"', "。".encode(), "…".encode())


class WordIds(dict):
    """A number below 2^21 for each word; starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) >= 2**21:
            self.clear()
        if len(words) >= 2**21:  # more words than numbers: count the distinct ones of this text alone
            return np.unique(np.array(words, dtype=object), return_inverse=True)[1].astype(np.int64)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice (the first included)."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) < 2**21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        windows = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(ids), bool)
    for i in range(3):
        hit[i : i + len(windows)] |= twice
    return int(hit.sum())


def _line(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    n, size = len(words), len(line)
    symbols = sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    bare = line.strip()
    return (
        1.0,
        min(1.0, 4 * symbols / size),
        sum(map(bytes.isupper, words)) / n,
        1 - len(set(words)) / n,
        min(1.0, 3 * words.count(b"|") / n),
        min(1.0, 4 * (line.count(b"!") + line.count(b"?")) / n / 4),
        min(1.0, n / 30),
        float(n < 5),
        float(bare.endswith(_ENDS)),
        float(seen),
        min(1.0, sum(map(bytes.isdigit, words)) / n),
    )


def lines_of(raw: bytes) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and words of each line that has a word, and how many of them repeat an earlier one."""
    features, sizes, repeats, seen = [], [], 0, set()
    for line in raw.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            features.append(_line(line, words, again))
            sizes.append(len(words))
    return features, sizes, repeats


#: Features of a chain's lines, and their labels.
Chain = tuple[np.ndarray, np.ndarray]


class Field:
    """A chain of two labels: 1 is content. ``weights`` scores content, ``moves`` pairs of labels."""

    def __init__(self, weights, moves, start: float = 0.0):
        self.weights, self.moves, self.start = np.asarray(weights, float), np.asarray(moves, float), float(start)

    def decode(self, scores: list[float]) -> list[int]:
        """Most likely labels for the lines' content scores; ties go to content."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        bad, good, back = 0.0, scores[0] + self.start, []
        for s in scores[1:]:
            to_bad, to_good = (1, 0)[bad + m00 > good + m10], (1, 0)[bad + m01 > good + m11]
            bad, good = (good + m10 if to_bad else bad + m00), (good + m11 if to_good else bad + m01) + s
            back.append((to_bad, to_good))
        label = int(good >= bad)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def _pieces(chains: list[Chain], most: int = 64) -> list[Chain]:
    """Long chains in pieces, so that one of them does not fill the arrays; no line is left out."""
    return [(x[at : at + most], y[at : at + most]) for x, y in chains for at in range(0, len(x), most)]


def train(chains: list[Chain], rounds: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Gradient ascent on the mean log likelihood of chains (lines x features, label of each line)."""
    chains = _pieces(chains)
    if len({int(v) for _, y in chains for v in y}) < 2:
        return Field([20.0] + [0.0] * (FEATURES - 1), [[0.0, 0.0], [0.0, 0.0]])
    longest, n = max(len(x) for x, _ in chains), len(chains)
    x, y, mask = np.zeros((n, longest, FEATURES)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(chains):
        x[i, : len(rows)], y[i, : len(rows)], mask[i, : len(rows)] = rows, labels, True
    each = 1.0 / (n * mask.sum(axis=1))  # chains weigh alike, however many lines they have
    inner = mask[:, 1:]
    ends, every = mask.sum(axis=1) - 1, np.arange(n)
    pairs = 2 * y[:, :-1] + y[:, 1:]
    seen = np.array([((pairs == k) & inner).sum(axis=1) @ each for k in range(4)]).reshape(2, 2)
    w, moves, start = np.zeros(FEATURES), np.zeros((2, 2)), 0.0
    speed = [np.zeros(FEATURES), np.zeros((2, 2)), 0.0]
    for _ in range(rounds):
        emit = np.stack([np.zeros((n, longest)), x @ w], axis=2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0] + np.array([0.0, start])
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp(ahead[:, t - 1, 0, None] + moves[0], ahead[:, t - 1, 1, None] + moves[1]) + emit[:, t]
        total = np.logaddexp.reduce(ahead[every, ends], axis=1)
        for t in range(longest - 2, -1, -1):
            after = emit[:, t + 1] + behind[:, t + 1]
            step = np.logaddexp(after[:, 0, None] + moves[:, 0], after[:, 1, None] + moves[:, 1])
            behind[:, t] = np.where((t < ends)[:, None], step, 0.0)
        marginal = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        g_w = np.einsum("nt,ntf,n->f", (y - marginal[:, :, 1]) * mask, x, each)
        pair = ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = np.einsum("ntab,nt,n->ab", np.exp(np.where(inner[:, :, None, None], pair, -700.0)), inner, each)
        g_start = ((y[:, 0] - marginal[:, 0, 1]) * each).sum()
        for i, g in enumerate((g_w - ridge * w, seen - expected - ridge * moves, g_start)):
            speed[i] = 0.8 * speed[i] + g
        w, moves, start = w + 4 * rate * speed[0], moves + rate * speed[1], start + rate * speed[2]
    return Field(w, np.clip(moves, -3.0, 3.0), start)


def line_labels(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Labels of a bad text's lines: 0 where the score is below 0, and for the lowest scores until half of the words are such."""
    labels = (scores >= 0).astype(int)
    for i in np.argsort(scores, kind="stable"):
        if 2 * sizes[labels == 0].sum() >= sizes.sum():
            break
        labels[i] = 0
    return labels


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], turns: int = 3, seed: int = 3) -> Field:
    """A field from texts (lines x features, words of each line, the text's label)."""
    good = [(x, np.ones(len(x), int)) for x, _, label in texts if label == 1]
    bad = [(x, sizes) for x, sizes, label in texts if label == 0]
    marked = [(x, np.zeros(len(x), int)) for x, _ in bad]
    if not good or not bad:
        return train([*good, *marked])
    rng = random.Random(seed)
    for turn in range(turns + 1):
        mixed = []
        for x, y in marked if turn else ():
            runs = np.split(np.arange(len(y)), np.flatnonzero(np.diff(y)) + 1)
            run = rng.choice([r for r in runs if y[r[0]] == 0])[:12]
            host, at = good[rng.randrange(len(good))][0], rng.random()
            cut = round(at * len(host))
            mixed.append((np.concatenate([host[:cut], x[run], host[cut:]]), np.r_[np.ones(cut, int), np.zeros(len(run), int), np.ones(len(host) - cut, int)]))
        field = train([*good, *marked, *mixed], 120 if turn == turns else 40)
        marked = [(x, line_labels(x @ field.weights, sizes)) for x, sizes in bad]
    return field


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", docs_per_label: int = 250, chars: int = 4_000_000
) -> Field:
    """Trains on at most 2 x ``docs_per_label`` whole texts, of ``chars`` characters together for each label."""
    texts = []
    for _, value, y in labelled_texts(docs, labels, key, text, label, docs_per_label, chars):
        raw = value.encode("utf-8", "surrogatepass")
        if len(raw.split()) >= LEAST_WORDS:
            found, sizes, _ = lines_of(raw)
            texts.append((np.array(found), np.array(sizes), y))
    return fit(texts)


def judge(text: str | None, ids: WordIds, field: Field, share: float = SHARE) -> tuple:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    chars = len(text or "") - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    repeated = repeated_words(ids.of(words))
    failed = n < LEAST_WORDS or 100 * repeated > 50 * n
    features, sizes, repeats = lines_of(raw) if n else ([], [], 0)
    content = 0.0
    if features:
        labels = field.decode((np.array(features) @ field.weights).tolist())
        content = sum(s for s, good in zip(sizes, labels, strict=True) if good) / n
    return n, chars, symbols, repeats, repeated, failed, not failed and content >= share, round(content, 6)


_FIELDS = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("content_share", T.DoubleType()),
)


def rules(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the base counts, base_failed, kept, content_share for each row."""

    def setup():
        ids = WordIds()
        return lambda texts: tuple(map(list, zip(*(judge(t, ids, field) for t in texts), strict=True))) if texts else ([],) * len(_FIELDS)

    return append(spread(docs.select(key, text)), [text], _FIELDS, setup).drop(text)


def keep_content(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The documents kept, with all their columns."""
    name = fresh(docs, "kept")

    def setup():
        ids = WordIds()
        return lambda texts: ([judge(t, ids, field)[6] for t in texts],)

    return append(spread(docs), [text], [(name, T.BooleanType())], setup).filter(name).drop(name)
