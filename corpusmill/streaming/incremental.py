"""Incremental paths: windows with a watermark, first-wins duplicates, moving statistics with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.session import _shared_folder, ship


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 100) -> DataFrame:
    """A table's files as a stream; new files are new batches."""
    ship(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir}/{name}.parquet*")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def window_totals(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events and their sum by window and type; later than ``late`` behind the newest is dropped."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    made = events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return made.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart; later than ``late`` behind the newest is dropped.

    ``late`` None: nothing is dropped in any order of arrival; for complete results, which keep all state anyway.
    """
    rows = events if late is None else events.withWatermark("ts", late)
    made = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def first_of_each_text(docs: DataFrame, at: str | None = None, late: str = "1 day") -> DataFrame:
    """One document of each text (null texts are one text).

    State is one hash a text. With a time column ``at`` it is bounded: a text is forgotten ``late``
    after it was last met, so a copy that comes later passes again.
    """
    rows = docs.withColumn("text_hash", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null")))
    if at is None:
        return rows.dropDuplicates(["text_hash"]).drop("text_hash")
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["text_hash"]).drop("text_hash")


def rolling(old: list[float], new: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the last ``window`` values at each of ``new``, itself included; one value has no deviation."""
    every = np.concatenate([np.asarray(old, float), new])
    means, sds = np.empty(len(new)), np.empty(len(new))
    for i in range(len(new)):
        frame = every[max(0, len(old) + i + 1 - window) : len(old) + i + 1]
        means[i] = frame.mean()
        sds[i] = frame.std(ddof=1) if len(frame) > 1 else np.nan
    return means, sds


def _moving(scores: DataFrame, key: str, seq: str, value: str, window: int, columns: str, judge: Callable) -> DataFrame:
    """key, seq, value and what ``judge`` (values, means, deviations) gives; state of a key: ``window`` values."""

    def step(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values(seq, kind="stable")
        old = list(state.get[0]) if state.exists else []
        values = rows[value].to_numpy(float)
        means, sds = rolling(old, values, window)
        state.update(((old + values.tolist())[-window:],))
        yield pd.DataFrame({key: group[0], seq: rows[seq].to_numpy(), value: values, **judge(values, means, sds)})

    rows = scores.select(key, seq, value)
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"{key} {names[key]}, {seq} {names[seq]}, {value} double, {columns}"
    return rows.groupBy(key).applyInPandasWithState(step, schema, "last array<double>", "append", GroupStateTimeout.NoTimeout)


def moving_cutoffs(scores: DataFrame, window: int = 500, lower: float = 2.0) -> DataFrame:
    """lang, doc_id, score, cutoff, keep against the last ``window`` scores of the language.

    State of a key: ``window`` scores. Rows of a micro-batch are taken in order of doc_id. One
    language's sequence is one task by definition; the batch form splits it (``operators.windows``).
    """

    def judge(values, means, sds):
        cutoff = np.round(means - lower * sds, 6)
        return {"cutoff": cutoff, "keep": np.isnan(cutoff) | (values >= cutoff)}

    return _moving(scores, "lang", "doc_id", "score", window, "cutoff double, keep boolean", judge)


def feature_levels(values: DataFrame, key: str, seq: str, value: str, window: int = 100, band: float = 0.5) -> DataFrame:
    """key, seq, value, level: 0, 1 or 2 against the last ``window`` values of the key, as ``moving_cutoffs`` keeps them."""

    def judge(found, means, sds):
        means, sds = np.round(means, 6), np.round(sds, 6)
        return {"level": np.where(np.isnan(sds), 1, np.where(found < means - band * sds, 0, np.where(found > means + band * sds, 2, 1)))}

    return _moving(values, key, seq, value, window, "level long", judge)


def running_counts(stream: DataFrame, by: list[str], path: str, every: str | None = None):
    """A query that keeps the counts by ``by`` in a folder, replaced with each batch; it returns when all that is there is read."""

    def put(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").json(path)

    writer = stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").foreachBatch(put)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the streaming engine to Parquet in the shared folder, read back.

    ``complete`` results are replaced with each batch. A restart with the same folder goes on where the last
    batch ended.
    """
    import uuid

    spark = stream.sparkSession
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
