import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritrove.operators.ranking import numbered
from veritrove.plans.durable import stored
from veritrove.plans.skew import frequent, hot_bound, hot_join, salted_join


@pytest.fixture
def sides(spark):
    """Rows of which half have the same key, none null or without a partner but a few, and the number of rows of each key."""
    pick = random.Random(1)
    rows = [(i, "hot" if i % 2 else pick.choice(["a", "b", "c", None, "lost"])) for i in range(4000)]
    large = stored(spark.createDataFrame(rows, "n bigint, key string").repartition(6))
    weights = stored(large.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("w")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield rows, large, weights
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_join(spark, sides):
    rows, large, weights = sides
    small = stored(weights.where("key <> 'lost'").withColumn("id", F.length("key")))
    got = hot_join(large, small, ["key"], "w", len(rows), least=1000)
    assert plan(got).count("BroadcastHashJoin") == 2 and plan(got).count("SortMergeJoin") == 1
    assert sorted((r["n"], r["key"], r["id"]) for r in got.collect()) == sorted((n, k, len(k)) for n, k in rows if k not in (None, "lost"))
    assert got.columns == ["key", "n", "id"]
    # what is shuffled holds no hot key
    assert not [k for k, w in Counter(k for _, k in rows if k).items() if w > 1000 and k != "hot"]
    assert hot_join(large.limit(0), small, ["key"], "w", 0).count() == 0


def test_salted_join(spark, sides):
    rows, large, weights = sides
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("b", 4), ("b", 4), ("none", 5)], "key string, v int")
    got = salted_join(large, other, ["key"], weights, "w", len(rows), least=100)
    want = Counter((n, k, v) for n, k in rows for q, v in [("hot", 1), ("hot", 2), ("a", 3), ("b", 4), ("b", 4)] if k == q)
    assert Counter((r["n"], r["key"], r["v"]) for r in got.collect()) == want
    assert got.columns == ["key", "n", "v"] and "__part" in plan(got)
    # the rows of the hot key meet in many parts
    dealt = large.withColumn("part", F.pmod(F.xxhash64("n", "key"), F.lit(20))).where("key = 'hot'").groupBy("part").count().collect()
    assert len(dealt) == 20 and max(r["count"] for r in dealt) < 200


def test_few_keys_can_be_hot():
    assert hot_bound(10) == 100_000 and hot_bound(10**9) == 500_000 and 10**9 / hot_bound(10**9) <= 2000


def test_frequent(spark):
    pick = random.Random(2)
    values = [pick.choice([5, 5, 5, 7, None]) if i % 3 else pick.getrandbits(40) for i in range(6000)]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(5)
    assert {r["key"] for r in frequent(frame, 100, 40).collect()} == {5, 7}
    assert {r["key"] for r in frequent(frame, 1500, 40).collect()} == {5}
    assert frequent(frame, 10_000).count() == 0 and frequent(frame.limit(0), 1).count() == 0


def test_numbered(spark):
    keys = stored(spark.createDataFrame([(f"k{i}",) for i in range(500)], "key string"))
    assert sorted(r["id"] for r in numbered(keys, "key", "id").collect()) == list(range(500))
    assert numbered(keys.limit(0), "key", "id").count() == 0
