"""Data-quality reports: null profile, column profile, shape, key uniqueness, length limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: null count, null percent and table row count.

    A single aggregation pass computes every count; the result is unpivoted
    into rows."""
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.sum(F.col(c).isNull().cast("long")).alias(f"_n{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', _n{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("_rows", f"stack({len(cols)}, {stack}) AS (column_name, null_count)")
    return long.select(
        "column_name",
        F.col("null_count").cast("long").alias("null_count"),
        (F.col("null_count") / F.col("_rows") * 100).alias("null_pct"),
        F.col("_rows").cast("long").alias("row_count"))


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (a primary-key check)."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def over_length(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Rows whose string columns exceed VARCHAR-style limits."""
    return df.filter(_any_over(limits))


def _any_over(limits: Mapping[str, int]) -> Column:
    cond = F.lit(False)
    for c, n in limits.items():
        cond = cond | (F.length(F.col(c)) > n)
    return cond


#: Values that the heavy-hitter summary of a column tracks; counts are exact for columns with
#: no more distinct values.
TRACKED = 10_000


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 1,
                   limits: Mapping[str, int] | None = None, tracked: int = TRACKED,
                   lg: int = 14) -> DataFrame:
    """One row per column, from one aggregation over all of them: ``column_name, row_count,
    null_count, min_length, max_length, over_limit, distinct_estimate, top_values``.

    Lengths are those of the value as text; ``over_limit`` counts values longer than the
    column's entry in ``limits`` (NULL without one).  The distinct count comes from a
    HyperLogLog sketch of ``2^lg`` buckets, ``top_values`` (an array of value and count) from
    a summary of ``tracked`` values: every value with more than ``4 / tracked`` of the
    rows is in it.  In a column of more distinct values its counts are estimates, and it may
    be empty (a column of keys); :func:`value_report` counts them all.  Each task sends one
    row of sketches, whatever the column holds."""
    cols = list(columns or df.columns)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(cols)])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        v, limit = F.col(f"_{i}"), (limits or {}).get(c)
        aggs.append(F.struct(
            F.lit(c).alias("column_name"),
            (F.count(F.lit(1)) - F.count(v)).alias("null_count"),
            F.min(F.length(v)).alias("min_length"),
            F.max(F.length(v)).alias("max_length"),
            (F.count(F.when(F.length(v) > limit, 1)) if limit is not None
             else F.lit(None).cast("long")).alias("over_limit"),
            F.hll_sketch_estimate(F.hll_sketch_agg(v, lg)).alias("distinct_estimate"),
            F.expr(f"transform(approx_top_k(_{i}, {top}, {tracked}) FILTER (WHERE _{i} IS NOT NULL), "
                   f"x -> struct(x.item AS value, x.count AS count))").alias("top_values"),
        ).alias(f"_c{i}"))
    wide = text.agg(*aggs)
    return (wide.select(F.col("_rows").alias("row_count"),
                        F.inline(F.array(*[F.col(f"_c{i}") for i in range(len(cols))])))
                .select("column_name", "row_count", "null_count", "min_length", "max_length",
                        "over_limit", "distinct_estimate", "top_values"))


def value_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, exact: ``column_name, distinct_count, top_count`` (rows of the most
    frequent value, NULL without one) over the non-null values as text.

    Rows are counted per column and value, in each task first, then the counts per column; no
    task holds all values of a column.  A table without rows has no row here."""
    cols = list(columns or df.columns)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    counts = (text.unpivot([], [F.col(f"`{c}`") for c in cols], "column_name", "_v")
                  .groupBy("column_name", "_v").agg(F.count(F.lit(1)).alias("_n")))
    return counts.groupBy("column_name").agg(
        F.count("_v").alias("distinct_count"),
        F.max(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("top_count"))


def table_report(df: DataFrame, keys: Sequence[str], limits: Mapping[str, int]) -> DataFrame:
    """One row: ``row_count, column_count, duplicate_keys`` (keys that occur more than once)
    and ``over_length`` (rows with a text over its limit)."""
    return df.select(
        F.lit(1).alias("_one"),
        F.coalesce(_any_over(limits), F.lit(False)).alias("_over"), *keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_over").cast("long")).alias("_over")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("duplicate_keys"),
        F.coalesce(F.sum("_over"), F.lit(0)).alias("over_length"))
