"""Arrow-batched row functions and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.session import fresh, ship


def append(
    df: DataFrame, columns: Sequence[str], fields: Sequence[tuple[str, T.DataType]], setup: Callable[[], Callable]
) -> DataFrame:
    """``df`` with ``fields`` added, computed batch by batch from ``columns``.

    ``setup()`` runs once in each task and gives the function that turns lists of the columns'
    values into a tuple of lists (or numpy arrays), one for each field. No state passes from batch
    to batch but caches, so a task that runs again gives the same rows.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])
    arrow = to_arrow_schema(schema)
    kinds, positions = arrow.types[len(df.columns) :], [df.columns.index(c) for c in columns]

    def run(batches):
        f = setup()
        for batch in batches:
            made = f(*(batch.column(i).to_pylist() for i in positions))
            added = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=arrow.names)

    return df.mapInArrow(run, schema)


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows for each value of ``label``: those whose ``key`` hashes lowest.

    Aggregates first count each label by the top bits of the hash; only the few hash ranges that can
    hold the lowest rows are ranked, so no task meets all rows of a label.
    """
    order, part, rank = (fresh(rows, n) for n in ("hash_order", "hash_range", "rank"))
    rows = rows.withColumn(order, F.xxhash64(F.col(key).cast("string")))
    rows = rows.withColumn(part, F.shiftright(F.col(order), 52))
    counts = rows.groupBy(label, part).count()
    before = Window.partitionBy(label).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(rank, F.coalesce(F.sum("count").over(before), F.lit(0))).filter(F.col(rank) < per_label)
    low = rows.join(F.broadcast(counts.select(label, part)), [label, part], "left_semi")
    ranked = low.withColumn(rank, F.row_number().over(Window.partitionBy(label).orderBy(order, key)))
    return ranked.filter(F.col(rank) <= per_label).drop(order, part, rank)


def labelled_texts(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int, chars: int, kinds: Sequence[int] = (0, 1)
) -> list[tuple]:
    """(key, text, label) of a bounded sample, in an order that does not follow the ids: at most ``per_label`` rows a label.

    Texts are whole. Rows go by the lowest hash of their id, as long as a label's texts hold ``chars``
    characters together; a text that does not fit is passed over. An id on several rows counts once,
    with its first text by value, so the sample is the same in every run. Null ids, texts and labels are not taken.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(*kinds) & F.col("key").isNotNull())
    ids = bounded_sample(known.distinct(), "label", "key", per_label)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    # the ids are at most per_label x labels
    rows = rows.join(F.broadcast(ids), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    rows = rows.withColumns({"size": F.length("text"), "order": F.xxhash64(F.col("key").cast("string"))}).filter(F.col("size") <= chars)
    so_far = Window.partitionBy("label").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0)
    fits = rows.withColumn("total", F.sum("size").over(so_far)).filter(F.col("total") <= chars)
    return [tuple(r) for r in fits.orderBy("order", "key", "label").select("key", "text", "label").collect()]
