"""Skew-aware equi-join: same rows as a plain join, hot keys spread over the tasks."""

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from scorekit.operators.skew import hot_keys, skew_join
from scorekit.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    """Half of 40,000 rows on one key, a fifth on NULL, the rest on 997 keys."""
    i = F.col("id")
    key = F.when(i % 2 == 0, F.lit(7)).when(i % 5 == 1, F.lit(None)).otherwise(100 + i % 997)
    return materialize(spark.range(40_000).select(i.alias("row"), key.cast("long").alias("k"),
                                                  (i % 3).alias("_salt")), "skewed")


@pytest.fixture(scope="module")
def side(spark):
    keys = [(k, f"v{k}") for k in range(0, 1200, 2)] + [(7, "seven"), (7, "again"), (None, "none")]
    return spark.createDataFrame(keys, "k long, v string")


def found(df):
    return Counter(map(tuple, df.select("row", "k", "_salt", "v").collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_equals_a_plain_join(rows, side, how, null_safe):
    k = side.withColumnRenamed("k", "k2")
    cond = rows["k"].eqNullSafe(k["k2"]) if null_safe else rows["k"] == k["k2"]
    assert found(skew_join(rows, side, ["k"], how, null_safe, chunks=64)) == found(
        rows.join(k, cond, how))


def test_hot_keys_are_few_and_counted(rows):
    hot = {r["k"]: r["_salts"] for r in hot_keys(rows, ["k"], 64).collect()}
    assert hot == {7: 32, None: -(-4000 * 64 // 40_000)}
    assert hot_keys(rows, ["k"], 1).count() == 0


def test_no_task_holds_twice_the_median(spark, rows, side):
    """Rows of a join partition, with plain shuffle joins and eight of them."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)

        def loads(df):
            got = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            return sorted(r["count"] for r in got)

        unique = side.where("v != 'again' and v != 'seven'").union(
            spark.createDataFrame([(7, "seven")], side.schema))
        even = loads(skew_join(rows, unique, ["k"], "left", True, chunks=512))
        plain = loads(rows.join(unique, "k", "left"))
        assert sum(even) == sum(plain) == 40_000 and len(even) == 8
        assert max(even) <= 2 * median(even) < max(plain)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_two_columns_and_empty_tables(spark, rows, side):
    both = rows.withColumn("g", F.col("row") % 2)
    s = side.withColumn("g", F.lit(0).cast("long"))
    got = skew_join(both, s, ["g", "k"], "left", chunks=16)
    want = both.join(s, ["g", "k"], "left")
    assert found(got) == found(want)
    assert skew_join(rows.limit(0), side, ["k"]).count() == 0
    assert skew_join(rows, side.limit(0), ["k"], "left").count() == 40_000


def test_rejects_other_joins(rows, side):
    with pytest.raises(ValueError):
        skew_join(rows, side, ["k"], "full")
