"""Texts to vectors by a function that the caller names; a hashing vector needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.functions.arrow import map_rows

#: Made once in each task (a model may be loaded there): gives the function from a text to a vector, or null to skip it.
Embedder = Callable[[], Callable[[str], list[float] | None]]


def hashing(size: int = 64) -> Embedder:
    """Signed counts of words by hash; a text without words is skipped."""

    def setup():
        memo: dict[str, tuple[int, int]] = {}

        def place(word):
            found = memo.get(word)
            if found is None:
                if len(memo) > 200_000:
                    memo.clear()
                digest = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
                found = memo[word] = int(digest[0], 16) % size, 1 if int(digest[1], 16) < 8 else -1
            return found

        def run(text):
            words = text.lower().split()
            vector = [0.0] * size
            for word in words:
                at, sign = place(word)
                vector[at] += sign
            return (vector, sorted({place(w)[0] for w in words})) if words else None

        return lambda text: run(text)

    return setup


def embed(docs: DataFrame, embedder: Embedder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, embedding, seen (the dimensions that a text touched, if the embedder tells): null for null texts and skipped ones."""

    def setup():
        f = embedder()

        def run(value):
            made = f(value) if value else None
            if made is None:
                return None, None
            return made if isinstance(made, tuple) else (list(made), list(range(len(made))))

        return run

    fields = [("embedding", T.ArrayType(T.DoubleType())), ("seen", T.ArrayType(T.IntegerType()))]
    return map_rows(docs, [text], fields, setup, keep=[key])
