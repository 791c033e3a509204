"""Physical-plan checks: pushdown, pruning, top-k limits, no single-partition funnels."""

from scorekit.plans import analyses as A
from scorekit.sources.bindings import companies, stored

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_topk_uses_window_group_limit(spark):
    df = stored(spark, SF_SMALL, "companies")
    for q in (A.credibility_rank(df), A.overperformers(df),
              A.emerging_employers(df, as_of_year=2002)):
        assert "WindowGroupLimit" in _plan(q)


def test_filters_and_columns_reach_the_scan(spark):
    df = stored(spark, SF_SMALL, "companies")
    plan = _plan(A.credibility_rank(df))
    assert "PushedFilters: [IsNotNull(Rating), IsNotNull(RatingCount)]" in plan
    assert "ReadSchema: struct<Name:string,Rating:double,RatingCount:int,Country:string>" in plan


def test_lineitem_is_aggregated_before_the_join(spark):
    plan = _optimized(companies(spark, SF_SMALL))
    # the per-order aggregate sits below the orders join
    agg = plan.index("Aggregate [l_orderkey#")
    join = plan.index("Join LeftOuter, (o_orderkey#")
    assert agg > join  # printed below (= evaluated before) the orders join


def test_global_ntile_not_single_partition(spark):
    df = stored(spark, SF_SMALL, "companies")
    assert "SinglePartition" not in _plan(A.overperformers(df))


def test_scalar_subqueries_instead_of_cross_join(spark):
    df = stored(spark, SF_SMALL, "companies")
    plan = _plan(A.credibility_rank(df))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Subquery" in plan


def test_stored_joins_broadcast_by_bytes(spark):
    from pyspark.sql import functions as F

    from scorekit.session import join_stored
    rows = stored(spark, SF_SMALL, "companies")
    stats = rows.groupBy("Country").agg(F.count(F.lit(1)).alias("n"))
    assert "BroadcastHashJoin" in _plan(join_stored(rows, stats, ["Country"]))
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "16")  # the table is larger than that
    try:
        assert "SortMergeJoin" in _plan(join_stored(rows, stats, ["Country"]))
    finally:
        spark.conf.set(key, old)


def test_rankings_have_one_plan(spark):
    plan = _plan(A.composite_rank(stored(spark, SF_SMALL, "companies"), as_of_year=2002))
    assert "_seg_off" in plan and "SinglePartition" not in plan
