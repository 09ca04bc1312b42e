"""Joins, numbering and context with one key that holds most rows."""

import random

from pyspark.sql import functions as F

from goldseam.operators import joins


def skewed(n=600):
    rng = random.Random(7)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", i) for i in range(n)]


def test_skew_join_equals_plain_join(spark, rows):
    left = spark.createDataFrame(skewed(), "k string, v int").repartition(5)
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("other", 4)], "k string, w int")
    for how in ("inner", "left"):
        got = joins.skew_join(left, right, ["k"], how, rows_per_split=50)
        assert rows(got, "k", "v", "w") == rows(left.join(right, "k", how), "k", "v", "w")


def test_skew_join_of_equal_rows(spark):
    left = spark.createDataFrame([("hot", 1)] * 500, "k string, v int")
    right = spark.createDataFrame([("hot", 2)], "k string, w int")
    assert joins.skew_join(left, right, ["k"], rows_per_split=50).count() == 500


def test_equal_rows_of_a_hot_key_are_spread(spark, rows):
    """Copies of one row, some of it in nulls, beside different rows of the same key and of others."""
    data = [("hot", 1)] * 400 + [("hot", None)] * 120 + [("hot", i) for i in range(150)] + [("a", 1)] * 3 + [(None, 2)] * 90
    left = spark.createDataFrame(data, "k string, v int").repartition(5)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3)], "k string, w int")
    for how in ("inner", "left"):
        got = joins.skew_join(left, right, ["k"], how, rows_per_split=50)
        assert rows(got, "k", "v", "w") == rows(left.join(right, "k", how), "k", "v", "w")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few here
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert max(r["count"] for r in sizes) < 0.6 * got.count()


def test_without_a_hot_key_the_join_is_plain(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    plan = joins.skew_join(left, left.withColumnRenamed("v", "w"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "_split" not in plan


def test_hot_keys_lists_only_large_ones(spark):
    df = spark.createDataFrame(skewed(), "k string, v int")
    hot = joins.hot_keys(df, ["k"], rows_per_split=50).collect()
    assert [r.k for r in hot] == ["hot"] and hot[0]["_splits"] >= 6


def test_running_number_is_global_and_ordered(spark):
    data = [(i % 7, i) for i in range(500)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "a int, b int").repartition(6)
    got = joins.running_number(df, ["a", "b"], "no", blocks=5).collect()
    expected = {pair: n for n, pair in enumerate(sorted(data), 1)}
    assert {(r.a, r.b): r.no for r in got} == expected


def brute_context(data, depth):
    by_key = {}
    for key, at, text in sorted(data):
        by_key.setdefault(key, []).append((at, text))
    return {
        (key, at): "\n".join(t for _, t in turns[max(0, i - depth) : i])
        for key, turns in by_key.items()
        for i, (at, _) in enumerate(turns)
    }


def test_context_in_ranges_equals_one_window(spark):
    rng = random.Random(3)
    data = [("hot", i, f"h{i}") for i in range(300)] + [
        (f"k{k}", i, f"{k}.{i}") for k in range(15) for i in range(rng.randrange(1, 9))
    ]
    df = spark.createDataFrame(data, "k string, turn int, text string").repartition(4)
    expected = brute_context(data, 3)
    plain = joins.preceding_context(df, "k", "turn", F.col("text"), 3, "context")
    assert {(r.k, r.turn): r.context for r in plain.collect()} == expected
    for blocks in (3, 40, 200):
        ranged = joins._context_by_range(df.withColumn("_line", F.col("text")), "k", "turn", 3, "context", blocks)
        assert {(r.k, r.turn): r.context for r in ranged.collect()} == expected


def test_context_of_a_null_key(spark):
    data = [(None, i, f"n{i}") for i in range(60)] + [("a", i, f"a{i}") for i in range(5)]
    df = spark.createDataFrame(data, "k string, turn int, text string").repartition(4)
    got = joins.preceding_context(df, "k", "turn", F.col("text"), 3, "context", 6).collect()
    wrong = [r for r in got if r.context != "\n".join(r.text[0] + str(t) for t in range(max(0, r.turn - 3), r.turn))]
    assert len(got) == 65 and not wrong


def test_skew_join_keeps_null_keys_of_the_left_side(spark):
    left = spark.createDataFrame([(None, i) for i in range(300)] + [("a", 1)], "k string, v int")
    right = spark.createDataFrame([("a", 2), (None, 3)], "k string, w int")
    got = joins.skew_join(left, right, ["k"], "left", rows_per_split=50)
    assert got.count() == 301 and got.filter("w is not null").count() == 1


def test_orphans_are_counted_per_key(spark, rows):
    child = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("b",)], "id string")
    assert rows(joins.orphan_keys(child, "k", parent, "id")) == [("a", 2)]
