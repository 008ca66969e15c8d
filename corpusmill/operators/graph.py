"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import store


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in ``edges`` (a, b): comp is the smallest node reached.

    Each round takes the smallest label of the neighbours, then that label's label, and is stored,
    so lost executors cost one round. Ends when no label moves.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp")
    while True:
        labels = store(labels)
        near = both.join(labels.toDF("b", "c"), "b").groupBy("a").agg(F.min("c").alias("near")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("to"))
        moved = store(step.join(labels.toDF("to", "jump"), "to").select("node", "comp", F.least("to", "jump").alias("to")))
        labels = moved.select("node", F.col("to").alias("comp"))
        if moved.filter("comp <> to").isEmpty():
            return labels
