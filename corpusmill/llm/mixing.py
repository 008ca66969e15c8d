"""Operator 2: mixing sources to target weights.

Temperature mixing: source shares p become weights w proportional to p^a. With a = 1 sources keep
their shares; a = 0 weighs them alike. The exponent is found by bisection, so that the weights reach
a target entropy, or the largest exponent below 1 that repeats no source more than ``most_repeats``
times. The budget (in tokens) is by default the smallest that draws every document at least once.

The weights are realised by block permutations. A source's documents fall into BLOCKS x BLOCKS
blocks by a hash of their id. Each epoch is a pass over all blocks in an order of its own (a hash of
seed, epoch and block). A source with budget b and t tokens gets floor(b / t) whole epochs and a
part of one more: blocks in that epoch's order until the tokens are used up. Inside the last block
documents follow by hash. A document is drawn if the draw begins below the budget, so a source
exceeds its budget by less than one document.

Sources are never collected into one task: their totals are pre-aggregated, the sums that the
bisection needs are aggregates over sources, and the last epoch is cut by descending two levels of
BLOCKS blocks each, then through the documents of one block.

Token counts are whitespace-separated words unless a column is named. Null text counts 0 tokens;
documents of 0 tokens come once for each whole epoch. A null source is a source of its own. Empty
tables give empty results. Rows that repeat an id are drawn each by itself; they stand beside each other in
every order, as their hashes are equal. Ties of the largest or smallest source don't matter: only their shares are used. A very long
text is one draw, so its source may exceed its budget by as much. Only the named columns are read; others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, cut

BLOCKS = 256
STEPS = 40
#: Exponents tried in one pass over the sources: a pass does the work of four bisections.
GRID = 15


def word_count(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.translate(flat, " ", "")) + 1).cast("long")


def _sums(totals: DataFrame, whole: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent a: sum of p^a, sum of p^a ln p, smallest p^(a - 1) and so on, in one pass."""
    share = F.col("tokens") / F.lit(float(whole))
    row = totals.filter("tokens > 0").agg(
        *(F.sum(F.pow(share, F.lit(a))) for a in exponents),
        *(F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in exponents),
        F.min(share), F.max(share),
    ).first()
    n = len(exponents)
    return [(row[i], row[n + i], row[2 * n], row[2 * n + 1]) for i in range(n)]


def exponent(totals: DataFrame, whole: int, entropy: float | None = None, most_repeats: float | None = None) -> float:
    """The exponent that meets the target, between 0 and 1.

    ``entropy`` is a share of the highest (all sources alike). ``most_repeats`` bounds the ratio of
    the passes over the source drawn most often to the passes over the one drawn least often.
    """
    highest = math.log(max(1, totals.filter("tokens > 0").count()))

    def too_flat(a: float, z: float, s: float, low: float, high: float) -> bool:
        if entropy is not None and math.log(z) - a * s / z > entropy * highest + 1e-12:
            return True
        return most_repeats is not None and (high / low) ** (1 - a) > most_repeats + 1e-12

    low, high = 0.0, 1.0
    for _ in range(math.ceil(STEPS / math.log2(GRID + 1))):
        tries = [low + (high - low) * (i + 1) / (GRID + 1) for i in range(GRID)]
        flat = [too_flat(a, *x) for a, x in zip(tries, _sums(totals, whole, tries), strict=True)]
        edge = flat.index(False) if False in flat else GRID
        low, high = ([low, *tries][edge], [*tries, high][edge])
    first = too_flat(0.0, *_sums(totals, whole, [0.0])[0])
    return high if first else 0.0


def _digit(seed: int, level: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(level)), F.lit(BLOCKS)).cast("int")


def _order(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _before(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``start``: the left budget less the tokens that come before, in their group."""
    window = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("begins", F.coalesce(F.sum("tokens").over(window), F.lit(0)))


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", tokens: str | None = None,
    entropy: float | None = None, most_repeats: float | None = 4.0, budget: int | None = None, seed: int = 7,
) -> DataFrame:
    """One row for each draw: key, source, n_tokens, weight, epoch, block, draw_order.

    Sorting a source's rows by epoch and draw_order gives its stream; weight is the source's.
    """
    counted = F.col(tokens).cast("long") if tokens else word_count(F.col(text))
    rows = cut(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(counted, F.lit(0).cast("long")).alias("n_tokens")))
    rows = rows.withColumns({"d1": _digit(seed, 1), "d2": _digit(seed, 2)})
    totals = cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    if not whole:
        return rows.select(F.col("doc_id").alias(key), F.col("source").alias(source), "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("epoch"), F.col("d1").alias("block"), _order(seed, "d1", "doc_id").alias("draw_order"))
    a = exponent(totals, whole, entropy, most_repeats)
    z, _, low, high = _sums(totals, whole, [a])[0]
    if budget is None:  # the largest source is drawn once
        budget = whole * high * z / high**a
    share = F.col("tokens") / F.lit(float(whole))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    plan = totals.withColumn("weight", weight)
    # rounding may put a whole number of passes just below it
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("weight") * F.lit(float(budget)) / F.col("tokens") + 1e-9)).otherwise(F.lit(1))
    plan = plan.withColumn("passes", passes.cast("long"))
    plan = plan.withColumn("left", F.greatest(F.lit(0), F.round(F.col("weight") * F.lit(float(budget)) - F.col("passes") * F.col("tokens"))).cast("long"))
    plan = broadcast_if_small(cut(plan.select(F.col("source").alias("s"), "weight", "passes", "left")))

    # the part of an epoch: whole first-level blocks, then whole second-level blocks of the next, then documents
    cells = cut(rows.groupBy("source", "d1", "d2").agg(F.sum("n_tokens").alias("tokens")))
    e = F.col("passes")
    cells = cells.join(plan, F.col("source").eqNullSafe(F.col("s"))).filter("left > 0")
    one = cells.groupBy("source", "passes", "left", "d1").agg(F.sum("tokens").alias("tokens")).withColumn("o", _order(seed, e, "d1"))
    one = _before(one, ["source"], ["o", "d1"]).filter("begins < left")
    one = one.select(F.col("source").alias("s1"), F.col("d1").alias("b1"), (F.col("left") - F.col("begins")).alias("rest"), (F.col("begins") + F.col("tokens") <= F.col("left")).alias("all1"))
    two = cells.join(one, F.col("source").eqNullSafe(F.col("s1")) & (F.col("d1") == F.col("b1"))).withColumn("o", _order(seed, e, "d1", "d2"))
    two = _before(two, ["source", "d1"], ["o", "d2"]).filter("all1 OR begins < rest")
    two = cut(two.select(F.col("source").alias("s2"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), (F.col("rest") - F.col("begins")).alias("room"), F.expr("all1 OR begins + tokens <= rest").alias("all2")))

    drawn = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    again = rows.join(two, F.col("source").eqNullSafe(F.col("s2")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")))
    whole_cells = again.filter("all2").select("doc_id", "source", "n_tokens", "d1", "d2")
    edge = again.filter("NOT all2").withColumn("o", F.xxhash64("doc_id", F.lit(seed))).withColumn("tokens", F.col("n_tokens"))
    edge = _before(edge, ["source", "d1", "d2"], ["o", "doc_id"]).filter("begins < room").select("doc_id", "source", "n_tokens", "d1", "d2")
    part = whole_cells.unionByName(edge).join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("epoch", F.col("passes"))
    full = drawn.filter("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    columns = ["doc_id", "source", "n_tokens", "weight", "epoch", "d1", "d2"]
    every = full.select(*columns).unionByName(part.select(*columns))
    place = F.hex(_order(seed, "epoch", "d1"))
    inner = F.hex(_order(seed, "epoch", "d1", "d2"))
    order = F.concat_ws("-", place, inner, F.hex(F.xxhash64("doc_id", F.lit(seed))))
    return every.select(F.col("doc_id").alias(key), F.col("source").alias(source), "n_tokens", F.round("weight", 9).alias("weight"), "epoch", (F.col("d1") * BLOCKS + F.col("d2")).alias("block"), order.alias("draw_order"))
