"""Operator 10: URL filter by rules and a logistic regression on hashed character n-grams.

DataFrame and SQL functions only. The model is trained (``pyspark.ml`` logistic regression, run in
the JVM) on the small labelled table below: counts of the character 3- and 4-grams of ``host`` and
of the first part of ``path``, hashed to ``BUCKETS`` slots. Digits count as one sign, so page
numbers don't matter. Rules come first: a rule fits its host and all subdomains if the path starts
with the rule's path; the longest rule wins (ties: the first by text).

The table's names are general words for such hosts; some addresses of the sample tables had been seen
when they were chosen, none was scored. Hosts of which the table holds no part lean to allow. Null url or one without ``://``: host and path empty, verdict from the model alone (its bias, as
there are no n-grams). A url may have any length. An empty table gives an empty result. Other columns are dropped;
repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.expr import let
from corpusmill.session import ascii_lower, cut

BUCKETS = 2048
GRAMS = (3, 4)
#: The labelled table: words of hosts to be blocked, words that stand beside them, and words of other hosts.
BLOCKED = (
    "adserver adclick adtrack banner popup popunder clickbait tracker pixel telemetry affiliate casino poker betting bets jackpot slots lottery roulette "
    "adult porn xxx escort webcams nude pills viagra pharmacy replica payday loans spam scam phishing malware trojan warez torrent keygen cracked"
).split()
BESIDE = ("cheap", "free", "online", "best", "win", "hot", "fast", "bonus", "shop", "store", "deals")
ALLOWED = (
    "news garden weather library university museum project history recipes city travel sport science books school health journal music archive "
    "maps bank bicycle radio code theatre art nature law forum review kitchen family cinema market street doctor teacher village mountain river "
    "language reading writing history training machine engine paper letter summer winter autumn spring bread coffee picture camera story"
).split()
PLACES = ("{}.example.com/en/1", "www.{}.example.net/de/2.html", "m.{}.example.org/fr/3/", "blog.{}.test/es/4")
#: Made-up names that stand for hosts of which nothing is known: these are allowed.
SYLLABLES = [a + b for a in ("b", "d", "l", "m", "n", "r", "s", "t", "th", "st") for b in ("a", "e", "i", "o", "u", "an", "en", "er", "in", "on")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty if there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def slots(host: Column, path: Column) -> Column:
    """Slots of the n-grams of host and path; empty for an empty address."""
    def of_length(text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.when(F.length(text) > n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def grams(text: Column) -> Column:
        return F.transform(F.concat(*(of_length(text, n) for n in GRAMS)), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))

    return let(F.regexp_replace(F.concat(F.lit("^"), host, path), "[0-9]+", "0"), grams)


def names() -> list[tuple[str, float]]:
    """(name of a host, 1 to block or 0): words to be blocked alone and beside others, other words, pairs of them and made-up names."""
    blocked = [*BLOCKED, *(f"{BESIDE[i % len(BESIDE)]}-{w}" for i, w in enumerate(BLOCKED)), *(f"{w}-{BESIDE[i % len(BESIDE)]}" for i, w in enumerate(BLOCKED, 5))]
    allowed = [*ALLOWED, *(f"{BESIDE[i % len(BESIDE)]}-{w}" for i, w in enumerate(ALLOWED)), *(f"{w}-{ALLOWED[i - 7]}" for i, w in enumerate(ALLOWED))]
    made_up = ["".join(SYLLABLES[(i * k + 7 * k) % len(SYLLABLES)] for k in (3, 11, 17)[: 2 + i % 2]) for i in range(100)]
    return [*((n, 1.0) for n in dict.fromkeys(blocked)), *((n, 0.0) for n in dict.fromkeys([*allowed, *made_up]))]


def labelled(named: Sequence[tuple[str, float]] | None = None) -> list[tuple[str, float]]:
    """(url, label) rows of the table: each name in each of the PLACES, the same for both kinds, so that only names tell them apart."""
    return [(f"http://{place.format(name)}", label) for name, label in named or names() for place in PLACES]


def train(spark: SparkSession, rows: Sequence[tuple[str, float]] | None = None) -> tuple[list[float], float]:
    """(weight of each slot, bias). The table is small by definition: at most 10,000 addresses."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = list(rows or labelled())
    if len(rows) > 10_000:
        raise ValueError("the labelled table is meant to be small")
    df = spark.createDataFrame(rows, "url string, label double").coalesce(1)
    host, path = split_url(F.col("url"))
    df = df.select("label", F.explode(F.array(slots(host, path))).alias("slots"))
    # the count of a slot is what the array loses without it
    ends = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda s: F.size(F.array_remove("slots", s)))
    dense = F.transform(ends, lambda left: (F.size("slots") - left).cast("double"))
    df = cut(df.select("label", array_to_vector(dense).alias("features")))
    model = LogisticRegression(regParam=0.003, maxIter=30, standardization=False).fit(df)
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls. ``rules``: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):  # the last that fits is taken
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_filter(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], model: tuple[list[float], float], key: str = "page_id", url: str = "url"
) -> DataFrame:
    """key, host, path, rule, verdict (allow or block), score (the model's chance of block)."""
    weights, bias = model
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("page_key"), host.alias("host"), path.alias("path"))
    rows = rows.select("page_key", "host", "path", slots(F.col("host"), F.col("path")).alias("_slots"))
    # the text of an array of constants, which becomes one constant
    table = F.expr(f"array({','.join(f'{w!r}D' for w in weights)})")
    margin = F.aggregate("_slots", F.lit(bias), lambda total, s: total + F.get(table, s))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    score = F.round(1 / (1 + F.exp(-margin)), 6)
    rows = rows.select("page_key", "host", "path", rule.alias("rule"), verdict.alias("_verdict"), score.alias("score"))
    judged = F.coalesce(F.col("_verdict"), F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(F.col("page_key").alias(key), "host", "path", "rule", judged.alias("verdict"), "score")
