"""Mergeable sketches and the one-pass column profile."""

import random

import pytest
from pyspark.sql import functions as F

from scorekit.operators import sketches as S
from scorekit.plans import quality as Q
from scorekit.plans.registry import _column_profile
from scorekit.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    """A hot group of 60,000 skewed values, a small one, one of a NULL key; five batches."""
    i, h = F.col("id"), F.pmod(F.xxhash64("id"), F.lit(100_000))
    g = F.when(i % 50 == 1, "small").when(i % 70 == 2, None).otherwise("hot")
    x = F.when(i % 13 == 5, None).otherwise(F.floor(F.pow(h / 1000, F.lit(2)))).cast("double")
    return materialize(spark.range(60_000).select(g.alias("g"), (i % 5).alias("batch"),
                                                  x.alias("x"), (h % 20_000).alias("v")), "sketched")


def test_small_groups_are_exact_and_merge_in_any_order(rows):
    small = rows.where("g = 'small'")
    values = sorted(r["x"] for r in small.where("x is not null").collect())
    by_batch = S.quantile_sketches(small, ["g", "batch"], "x")
    for sketches in (by_batch, by_batch.orderBy(F.desc("batch"))):
        got = S.merge_quantiles(sketches, ["g"], (0.25, 0.5, 1.0), ("q", "m", "top")).first()
        n = len(values)
        assert (got["n"], got["q"], got["m"], got["top"]) == (
            n, values[-(-n // 4) - 1], values[-(-n // 2) - 1], values[-1])


def test_large_groups_are_within_the_bound(rows):
    sketches = materialize(S.quantile_sketches(rows, ["g", "batch"], "x", k=400), "kll")
    got = S.median_within_bound(rows, ["g"], "batch", "x", sketches, k=400).collect()
    assert len(got) == 3 and all(r["within_bound"] for r in got)
    assert S.rank_error(400) < 0.02 and sum(r["n"] for r in got) == rows.where(
        "x is not null").count()


def test_a_wrong_median_is_not_within_the_bound(rows):
    off = S.quantile_sketches(rows.withColumn("x", F.col("x") * 2), ["g", "batch"], "x")
    got = S.median_within_bound(rows, ["g"], "batch", "x", off).collect()
    assert not any(r["within_bound"] for r in got if r["g"] == "hot")


def test_a_new_batch_adds_to_stored_sketches(rows):
    old = materialize(S.distinct_sketches(rows.where("batch < 4"), ["g", "batch"], "v"), "hll")
    new = S.distinct_sketches(rows.where("batch = 4"), ["g", "batch"], "v")
    got = {r["g"]: r["distinct"] for r in S.merge_distinct(old.unionByName(new), ["g"]).collect()}
    whole = S.merge_distinct(S.distinct_sketches(rows.repartition(7), ["g"], "v"), ["g"])
    assert got == {r["g"]: r["distinct"] for r in whole.collect()}  # the values alone decide
    exact = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    assert all(abs(got[g] - n) <= S.distinct_error() * n for g, n in exact.items())


def test_sketches_of_nothing(rows):
    none = rows.limit(0)
    assert S.merge_quantiles(S.quantile_sketches(none, ["g"], "x"), ["g"]).count() == 0
    assert S.merge_distinct(S.distinct_sketches(none, ["g"], "v"), ["g"]).count() == 0


def test_column_profile(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "bbb", None, "cc"]), i, None, float(i % 3)) for i in range(3000)]
    df = spark.createDataFrame(data, "s string, i long, `no.ne` string, d double")
    got = {r["column_name"]: r for r in Q.column_profile(df, top=2, limits={"s": 2}).collect()}
    texts = [s for s, *_ in data if s]
    assert got["s"]["null_count"] == 3000 - len(texts) and got["s"]["row_count"] == 3000
    assert (got["s"]["min_length"], got["s"]["max_length"]) == (1, 3)
    assert got["s"]["over_limit"] == texts.count("bbb") and got["i"]["over_limit"] is None
    counts = sorted(((texts.count(v), v) for v in set(texts)), reverse=True)[:2]
    assert [(t["count"], t["value"]) for t in got["s"]["top_values"]] == counts
    assert abs(got["i"]["distinct_estimate"] - 3000) < 90 and got["d"]["distinct_estimate"] == 3
    assert got["no.ne"]["null_count"] == 3000 and got["no.ne"]["top_values"] == []
    plan = Q.column_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "s string, i long")
    got = Q.column_profile(df).collect()
    assert [(r["row_count"], r["null_count"], r["min_length"], r["distinct_estimate"])
            for r in got] == [(0, 0, None, 0)] * 2


def test_value_report(spark):
    data = [("a", 1, None), ("a", 2, None), (None, 2, None), (None, 3, None), (None, 2, None)]
    df = spark.createDataFrame(data, "s string, `no.ne` int, z string")
    got = {r["column_name"]: tuple(r)[1:] for r in Q.value_report(df).collect()}
    assert got == {"s": (1, 2), "no.ne": (3, 3), "z": (0, None)}
    assert [tuple(r) for r in Q.value_report(df, ["s"]).collect()] == [("s", 1, 2)]


def test_column_profile_query_of_keys_and_nulls(spark):
    """More distinct names than the summary tracks, none frequent enough to stay in it."""
    i = F.col("id")
    raw = spark.range(3 * Q.TRACKED).select(
        F.concat(F.lit("n"), F.when(i < 9, 0).otherwise(i)).alias("Name"),
        F.when(i % 4 > 0, (i % 4).cast("string")).alias("Rating"),
        (i * 7).cast("string").alias("Rating Count"), F.lit("x" * 31).alias("Headquarters"),
        F.lit(None).cast("string").alias("Company_year"),
        (i % Q.TRACKED).cast("string").alias("Employees Count"))
    columns = ("row_count", "null_count", "max_length", "over_limit", "distinct_count",
               "estimate_within_3_percent", "top_count")
    got = {r["column_name"]: tuple(r[c] for c in columns) for r in _column_profile(raw).collect()}
    n = 3 * Q.TRACKED
    assert got == {
        "Name": (n, 0, 6, 0, n - 8, True, 9),
        "Rating": (n, n // 4, 1, None, 3, True, n // 4),
        "Rating Count": (n, 0, 6, None, n, True, 1),
        "Headquarters": (n, 0, 31, n, 1, True, n),
        "Company_year": (n, n, None, None, 0, True, None),
        "Employees Count": (n, 0, 4, None, Q.TRACKED, True, 3)}
    assert [tuple(r[c] for c in columns) for r in _column_profile(raw.limit(0)).select(*columns)
            .distinct().orderBy("over_limit").collect()] == [(0, 0, None, None, 0, True, None),
                                                  (0, 0, None, 0, 0, True, None)]


def test_table_report(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "x"), (2, None), (None, "abcd"), (None, "y")],
                               "k int, s string")
    assert tuple(Q.table_report(df, ["k"], {"s": 2}).first()) == (5, 2, 2, 2)
    assert tuple(Q.table_report(df.limit(0), ["k"], {"s": 2}).first()) == (0, 2, 0, 0)
