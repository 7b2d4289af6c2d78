"""The join back to aggregated keys equals a left join, and no task holds a hot key."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from broodline.functions.skew import SHARE, join_by_share


def tables(spark, seed, n=3000):
    """A key with half of the rows, rare keys, unknown keys, and keys without a group."""
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 5 + [f"k{r.randint(0, 900)}", None, "alone"]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(4)
    groups = df.where("k is not null and k <> 'alone'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("most"))
    return df, groups.withColumn("name", F.concat(F.lit("g"), "k")), n


@pytest.mark.parametrize("share", [SHARE, 3, 1])
def test_equals_a_left_join(spark, monkeypatch, share):
    from broodline.functions import skew

    monkeypatch.setattr(skew, "SHARE", share)
    df, groups, n = tables(spark, share)
    got = join_by_share(df, groups, "k", "n", n)
    assert got.columns == ["k", "i", "most", "name"]
    want = df.join(groups.drop("n"), "k", "left").select("k", "i", "most", "name")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_struct_key_with_unknown_fields(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), ("x", None, "c"), ("x", 2, "d")], "p string, q int, v string") \
        .withColumn("cell", F.struct("p", "q"))
    groups = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"))
    got = {r.v: r.first for r in join_by_share(df, groups, "cell", "n", 4).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_rows_of_the_hot_and_the_unknown_key_are_spread(spark):
    df, groups, n = tables(spark, 7, 20_000)
    df = df.where("k is null or k <> 'alone'")  # every known key has a group
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = join_by_share(df, groups, "k", "n", n).select("name", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    tasks = Counter(r.p for r in rows)
    assert len(tasks) == 8 and max(tasks.values()) < 0.2 * n  # the hot key alone has over half of the rows


def test_clashing_names_and_empty_sides(spark):
    df = spark.createDataFrame([("a", 1, 2, 3), ("b", 1, 2, 3)], "k string, is_hot int, spread int, hot_v int")
    groups = spark.createDataFrame([("a", 1, "x")], "k string, n long, v string")
    got = join_by_share(df, groups, "k", "n", 2)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2, 3, "x"), ("b", 1, 2, 3, None)]
    assert join_by_share(df.limit(0), groups, "k", "n", 0).count() == 0
    assert [r.v for r in join_by_share(df, groups.limit(0), "k", "n", 0).collect()] == [None, None]
