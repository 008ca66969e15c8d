"""Windows over ordered rows that don't need a whole key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusmill.session import fresh, store

BUCKET, BLOCK = 65_536, 8_192


def look_back(rows: DataFrame, key: str, seq: str, back: int, make: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``rows`` with the columns ``make`` gives for a frame of ``back`` preceding rows of the key.

    A key may hold any share of the rows: rows are numbered by counts of buckets of ``seq``, dealt in
    blocks of BLOCK rows, and each block gets the last ``back`` rows of the one before as context.
    A null key is a key of its own; rows of a null ``seq`` come first. Ties of ``seq`` are in no fixed order.
    The rows are stored first, as they are read twice.
    """
    if back >= BLOCK:
        raise ValueError("the frame is longer than a block")
    rows = store(rows, "sequence")
    bucket, before, at, own, block = (fresh(rows, n) for n in ("bucket", "before", "at", "own", "block"))
    rows = rows.withColumn(bucket, F.floor(F.col(seq) / BUCKET))
    sizes = rows.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("size_key"), F.col(bucket).alias("size_bucket"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    placed = rows.join(sizes, rows[key].eqNullSafe(sizes["size_key"]) & rows[bucket].eqNullSafe(sizes["size_bucket"])).drop("size_key", "size_bucket")
    place = F.row_number().over(Window.partitionBy(key, bucket).orderBy(seq)) - 1 + F.col(before)
    placed = placed.withColumn(at, place).withColumn(own, F.floor(F.col(at) / BLOCK))
    late = F.col(at) % BLOCK >= BLOCK - back
    blocks = F.when(late, F.array(own, F.col(own) + 1)).otherwise(F.array(own))
    dealt = placed.withColumn(block, F.explode(blocks))
    frame = Window.partitionBy(key, block).orderBy(at).rowsBetween(-back, 0)
    made = dealt.withColumns(make(frame))
    return made.filter(F.col(block) == F.col(own)).drop(bucket, before, at, own, block)


def moving_cutoff(rows: DataFrame, key: str, seq: str, score: str, window: int = 500, lower: float = 2.0, upper: float | None = None) -> DataFrame:
    """mean, sd and cutoff (mean - lower x sd) over the last ``window`` scores; keep: score >= cutoff.

    With ``upper`` the cutoff is mean + upper x sd and higher scores go. The row's own score counts.
    One score has no deviation: the row is kept.
    """
    # sums of whole millionths don't depend on their order
    millionths = F.round(F.col(score) * 1e6).cast("long")
    rows = look_back(rows, key, seq, window - 1, lambda f: {"mean": F.avg(millionths).over(f) / 1e6, "sd": F.stddev_samp(score).over(f)})
    rows = rows.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})
    rows = rows.withColumn("cutoff", F.round(F.col("mean") - lower * F.col("sd") if upper is None else F.col("mean") + upper * F.col("sd"), 6))
    fits = F.col(score) >= F.col("cutoff") if upper is None else F.col(score) <= F.col("cutoff")
    return rows.withColumn("keep", F.coalesce(fits, F.lit(True)))


def held_levels(rows: DataFrame, key: str, seq: str, level: str) -> DataFrame:
    """``rows`` with ``held``: levels 0, 1 and 2 with hysteresis. Level 2, once reached, holds through 1 until 0 is met.

    A row in the middle looks back to the last row of the key that is not. That row is sought in
    buckets of ``seq`` first and then among the buckets' last ones, so no key is one task. Null keys and ``seq`` as in ``look_back``.
    """
    rows = store(rows, "levels")
    bucket, strong, carried = (fresh(rows, n) for n in ("bucket", "strong", "carried"))
    rows = rows.withColumns({bucket: F.floor(F.col(seq) / BUCKET), strong: F.when(F.col(level) != 1, F.col(level))})
    lasts = rows.groupBy(key, bucket).agg(F.max_by(F.when(F.col(strong).isNotNull(), F.col(strong)), F.when(F.col(strong).isNotNull(), F.col(seq))).alias("last_strong"))
    ahead = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(F.col(key).alias("level_key"), F.col(bucket).alias("level_bucket"), F.last("last_strong", ignorenulls=True).over(ahead).alias(carried))
    met = rows.join(lasts, rows[key].eqNullSafe(lasts["level_key"]) & rows[bucket].eqNullSafe(lasts["level_bucket"])).drop("level_key", "level_bucket")
    inside = Window.partitionBy(key, bucket).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.last(strong, ignorenulls=True).over(inside), F.col(carried))
    held = F.when((F.col(level) == 1) & (before == 2), 2).otherwise(F.col(level))
    return met.withColumn("held", held.cast("long")).drop(bucket, strong, carried)
