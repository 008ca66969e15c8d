"""No stored table is broadcast for the size of its files."""

from corpusmill.llm import near_dedup
from corpusmill.session import broadcast_if_small, store


def _stored(spark):
    """20,000 rows of 56 bytes in files of a few kilobytes."""
    rows = spark.range(20_000, numPartitions=1).selectExpr("id % 2000 AS shingle", "id % 7 AS node", "id % 7 AS comp", "1L AS n", "1L AS place")
    return store(rows, "prefix")


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_near_dedup_measures_what_it_stored(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d e f w{i}") for i in range(4)], "doc_id long, text string")
    pairs_of, plans = near_dedup._prefix_pairs, []

    def spy(prefix):
        plans.append(_plan(pairs_of(_stored(spark))))
        return pairs_of(prefix)

    monkeypatch.setattr(near_dedup, "_prefix_pairs", spy)
    key, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "500k")
    try:
        assert near_dedup.keep_one(docs).count() == 4
        assert spark.conf.get(key) == "500k" and spark.conf.get(adaptive, None) is None
    finally:
        spark.conf.set(key, before)
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


def test_a_table_judged_too_large_is_not_broadcast(spark):
    rows = _stored(spark)
    few = spark.createDataFrame([(i,) for i in range(50)], "shingle long")
    assert "SortMergeJoin" in _plan(few.join(broadcast_if_small(rows, 100_000), "shingle"))
    assert "BroadcastHashJoin" in _plan(few.join(broadcast_if_small(rows), "shingle"))


def test_a_broadcast_table_takes_what_it_may(spark):
    rows = store(spark.range(20_000).toDF("gone"), "gone")
    docs = spark.range(50).toDF("doc_id")
    # 20,000 numbers are 2 MB once they are broadcast for such a join
    joined = docs.join(broadcast_if_small(rows, 1_000_000), docs["doc_id"].eqNullSafe(rows["gone"]), "left_anti")
    assert "SortMergeJoin" in _plan(joined) and joined.isEmpty()


def test_the_shorter_list_of_ids_is_joined(spark):
    copies = spark.createDataFrame([(i, "a b c d e f" if i < 8 else f"w{i} b c d e f") for i in range(10)], "doc_id long, text string")
    kept = near_dedup.keep_one(copies)
    assert "LeftSemi" in _plan(kept) and sorted(r.doc_id for r in kept.collect()) == [0, 8, 9]
    kept = near_dedup.keep_one(copies.filter("doc_id > 5").union(spark.createDataFrame([(None, "z y x w")], copies.schema)))
    assert "LeftAnti" in _plan(kept) and sorted((r.doc_id for r in kept.collect()), key=str) == [6, 8, 9, None]
