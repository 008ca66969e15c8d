"""Bigram language model with add-one smoothing, and perplexity under it."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, ship, spread, store


#: The same in SQL; D has doc_id and the words w.
BIGRAMS = "SELECT doc_id, w[i] AS a, w[i + 1] AS b, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM {D}) GROUP BY ALL"
SQL = f"""WITH big AS ({BIGRAMS}), ab AS (SELECT a, b, sum(n) AS c_ab FROM big GROUP BY ALL), fa AS (SELECT a, sum(n) AS c_a FROM big GROUP BY ALL),
v AS (SELECT count(*) AS v FROM fa) SELECT doc_id, round(exp(-sum(n * ln((c_ab + 1)::DOUBLE / (c_a + v))) / sum(n)), 2) AS ppl FROM big JOIN ab USING (a, b) JOIN fa USING (a), v GROUP BY doc_id"""


def bigram_counts(docs: DataFrame) -> DataFrame:
    """doc_id, a, b, n: how often word ``b`` follows ``a`` in each text; counted in the row, before any shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, firsts, seconds, counts = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split() if text else []
                pairs = Counter(zip(words, words[1:], strict=False))
                ids += [i] * len(pairs)
                firsts += [a for a, _ in pairs]
                seconds += [b for _, b in pairs]
                counts += pairs.values()
                if len(ids) > 100_000:
                    yield _rows(ids, firsts, seconds, counts)
                    ids, firsts, seconds, counts = [], [], [], []
            yield _rows(ids, firsts, seconds, counts)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, a string, b string, n long")


def _rows(ids: list, firsts: list, seconds: list, counts: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, firsts, seconds, counts), kinds, strict=True)], names=["doc_id", "a", "b", "n"])


def perplexity(docs: DataFrame) -> DataFrame:
    """doc_id, ppl = exp(-mean log p(b | a)), p = (count(a, b) + 1) / (count(a, .) + first words).

    Texts of fewer than two words have no row. A text's repeats of a pair are one row of the join, and
    counts of first words, far fewer, are broadcast if their number is small.
    """
    rows = store(bigram_counts(docs), "bigrams")
    pairs = rows.groupBy("a", "b").agg(F.sum("n").alias("c_ab"))
    firsts = store(rows.groupBy("a").agg(F.sum("n").alias("c_a")), "firsts")
    vocabulary = firsts.count()
    model = pairs.join(broadcast_if_small(firsts), "a").select("a", "b", F.log((F.col("c_ab") + 1) / (F.col("c_a") + vocabulary)).alias("logp"))
    scored = rows.join(model, ["a", "b"]).groupBy("doc_id").agg(F.sum(F.col("n") * F.col("logp")).alias("total"), F.sum("n").alias("n"))
    return scored.select("doc_id", F.round(F.exp(-F.col("total") / F.col("n")), 2).alias("ppl"))


def compounds(docs: DataFrame, least: int = 20) -> DataFrame:
    """first, second, n: pairs of neighbours met at least ``least`` times, as compound candidates."""
    return bigram_counts(docs).groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(F.col("a").alias("first"), F.col("b").alias("second"), "n")
