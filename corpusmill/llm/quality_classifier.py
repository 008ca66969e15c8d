"""Operator 7: quality by compression against dictionaries of good and of bad text.

Two zstandard dictionaries are trained, on text labelled good and on text labelled bad. A text is
cut into blocks of ``BLOCK`` bytes; each is compressed alone with either dictionary. The normalised
difference d = (bytes with the bad one - bytes with the good one) / (bytes of text + 32) is the
evidence; a logistic curve over d, fitted on labelled rows that the dictionaries have not seen,
turns it into a score. Short texts give little evidence, so the curve's slope and level may differ
for them: it also sees exp(-bytes / 200) and its product with d.

The labelled sample is bounded: ``docs_per_label`` rows of each label with the lowest hash of their
id, of ``chars`` characters together; every third of them is for the curve. Texts are whole, in the
sample and when they are scored, however long.

Null text counts as empty: d = 0. A label without rows or too little text for a dictionary: the
dictionary is plain text, or empty; with one label only, the score is that label's share. Rows
with null label or text are not learned from. Equal texts have equal scores. An empty table gives an
empty result. Other columns are dropped (``keep_good`` keeps all); repeated rows stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.batches import append, fresh, labelled_texts
from corpusmill.session import spread

BLOCK, LEVEL = 1024, 3
DICTIONARY = 100_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float, float]


def _encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


class Evidence:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (self._compressor(d) for d in (good, bad))

    @staticmethod
    def _compressor(data: bytes):
        known = None
        if data:
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False)

    def features(self, text: str | None) -> tuple[float, float, float]:
        raw = _encode(text)
        gap = 0
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK]
            gap += len(self.bad.compress(block)) - len(self.good.compress(block))
        d, short = gap / (len(raw) + 32), math.exp(-len(raw) / 200)
        return d, short, d * short


def _dictionary(texts: list[str]) -> bytes:
    parts = []
    for text in texts:
        raw = _encode(text)
        parts += [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
    parts = [p for p in parts if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(parts)[:DICTIONARY]


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; inputs scaled."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T * (p * (1 - p) + 1e-9) @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / scale), w[-1])


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model of (text, label) rows, in the order given: every third fits the curve."""
    texts = {label: [t for t, q in rows if q == label] for label in (0, 1)}
    seen = {label: [t for i, t in enumerate(ts) if i % 3] for label, ts in texts.items()}
    good, bad = _dictionary(seen[1]), _dictionary(seen[0])
    held = [(t, label) for label, ts in texts.items() for t in ts[::3]]
    if not texts[0] or not texts[1]:
        share = 0.5 if not rows else min(0.999, max(0.001, len(texts[1]) / len(rows)))
        return Model(good, bad, (0.0, 0.0, 0.0, math.log(share / (1 - share))))
    evidence = Evidence(good, bad)
    x = np.array([evidence.features(t) for t, _ in held])
    w = _fit_curve(x, np.array([float(q) for _, q in held]))
    return Model(good, bad, tuple(float(v) for v in w))


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", docs_per_label: int = 1500, chars: int = 8_000_000
) -> Model:
    """Fits on a bounded sample: at most ``docs_per_label`` whole texts and ``chars`` characters of each label reach the driver."""
    rows = labelled_texts(docs, labels, key, text, label, docs_per_label, chars)
    model = fit([(value, y) for _, value, y in rows])
    known = labels.select(key, F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col(key).isNotNull()).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    drawn = {q: max(1, sum(y == q for _, _, y in rows)) for q in (0, 1)}
    if len(counts) < 2:
        return model
    # the sample holds the labels in other shares than the table: move the curve's level back
    odds = math.log(counts[1] / counts[0]) - math.log(drawn[1] / drawn[0])
    return Model(model.good, model.bad, (*model.weights[:3], model.weights[3] + odds))


@lru_cache(maxsize=2)
def _evidence(good: bytes, bad: bytes) -> Evidence:
    return Evidence(good, bad)


def _scorer(shared):
    def setup():
        model = shared.value
        evidence, (a, b, c, bias) = _evidence(model.good, model.bad), model.weights

        def one(text):
            d, short, both = evidence.features(text)
            return round(1 / (1 + math.exp(-max(-30.0, min(30.0, a * d + b * short + c * both + bias)))), 6)

        return lambda texts: ([one(t) for t in texts],)

    return setup


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score (0 to 1), predicted (1 if score >= threshold). The dictionaries (0.2 MB) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = append(spread(docs.select(key, text)), [text], [("score", T.DoubleType())], _scorer(shared))
    return rows.select(key, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh(docs, "score")
    return append(spread(docs), [text], [(name, T.DoubleType())], _scorer(shared)).filter(F.col(name) >= threshold).drop(name)
