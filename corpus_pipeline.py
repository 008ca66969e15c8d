"""From raw documents to a training mix: five stages, each one of the operators of corpusmill.llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame. All but the last return documents with
their columns; the last returns the draws of the mix. Stages keep rows whole: what a stage removes
is what its operator rejects, nothing else. Empty documents tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontaminate, language_id, mixing, near_dedup, quality_classifier, quality_rules
from corpusmill.session import store, table


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts good."""
    labels = table(spark, sf_dir, "labels").filter(language_id.remainder("doc_id", 5) != 0)
    model = quality_classifier.learn(table(spark, sf_dir, "documents", "doc_id", "text"), labels)
    return quality_classifier.keep_good(docs, model)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and hold mostly content lines."""
    field = quality_rules.learn(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_content(docs, field)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words (op4's contract asks four)."""
    return near_dedup.keep_one(docs, size=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, decontaminate.prepare(table(spark, sf_dir, "benchmark")))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of the mix: each document at least once, small sources up to four times."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mix sources", mix_stage),
]

#: SQL can express neither the trained stages nor the hash orders.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
