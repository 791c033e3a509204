"""Mergeable sketches: medians and distinct counts that new batches add to.

An exact median or distinct count must look at all rows again when a batch comes.  A
sketch is a few kilobytes per group and batch that is stored, and the sketches of any
set of batches merge into that of their union, in any order:

* quantiles by KLL sketches (``kll_sketch_agg``), with a normalised rank error of
  about ``2.3 / k`` at 99 % confidence (:func:`rank_error`); while a group has no more
  than ``k`` values the result is exact;
* distinct counts by HyperLogLog (``hll_sketch_agg``), with a relative standard error of
  ``1.04 / sqrt(2^lg)`` (:func:`distinct_error`); the sketch depends on the values alone,
  so it is the same however the rows were dealt.

The sketch aggregates combine in each task: a hot group sends one sketch a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values a KLL sketch level holds; the largest that Spark allows is 65,535.
KLL_K = 4096
#: Base-2 logarithm of an HLL sketch's buckets (4 to 21).
HLL_LG = 14


def rank_error(k: int = KLL_K) -> float:
    """Bound of a quantile's normalised rank error at 99 % confidence."""
    return 2.296 / k ** 0.9021


def distinct_error(lg: int = HLL_LG) -> float:
    """Three standard errors of a distinct count, relative."""
    return 3 * 1.04 / 2 ** (lg / 2)


def quantile_sketches(df: DataFrame, group: Sequence[str], col: str, k: int = KLL_K) -> DataFrame:
    """``group..., sketch, n``: a sketch of ``col``'s non-null values per group (a batch is one
    more group column)."""
    rows = df.where(F.col(col).isNotNull())
    return rows.groupBy(*group).agg(
        F.kll_sketch_agg_double(F.col(col).cast("double"), F.lit(k)).alias("sketch"),
        F.count(F.lit(1)).alias("n"))


def merge_quantiles(sketches: DataFrame, group: Sequence[str], shares: Sequence[float] = (0.5,),
                    names: Sequence[str] = ("median",), k: int = KLL_K) -> DataFrame:
    """``group..., n, names...``: quantiles over the union of the sketches of each group.
    A quantile is a value of the data, the one at rank ``ceil(share * n)``."""
    merged = sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch", F.lit(k))
                                          .alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*group, "n", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias(a)
        for s, a in zip(shares, names)])


def distinct_sketches(df: DataFrame, group: Sequence[str], col: str | Column,
                      lg: int = HLL_LG) -> DataFrame:
    """``group..., sketch``: a sketch of the distinct non-null values per group."""
    return df.groupBy(*group).agg(F.hll_sketch_agg(col, lg).alias("sketch"))


def merge_distinct(sketches: DataFrame, group: Sequence[str], out: str = "distinct") -> DataFrame:
    """``group..., out``: distinct count over the union of the sketches of each group."""
    return sketches.groupBy(*group).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))


def median_within_bound(df: DataFrame, group: Sequence[str], batch: str, col: str,
                        sketches: DataFrame, k: int = KLL_K) -> DataFrame:
    """The sketched median against the rows themselves: ``group..., n, sketch_median,
    within_bound``.

    The rank of the sketched value is counted exactly; it holds if some rank of it (ties
    take a range of them) is within the error bound of the middle."""
    merged = merge_quantiles(sketches, group, k=k).withColumnRenamed("median", "sketch_median")
    side = merged.select(*[F.col(g).alias(f"_m_{g}") for g in group], "n", "sketch_median")
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_m_{g}"))
    x, m = F.col(col).cast("double"), F.col("sketch_median")
    ranks = (df.where(F.col(col).isNotNull()).join(side, cond)
               .groupBy(*group, "n", "sketch_median")
               .agg(F.count(F.when(x < m, 1)).alias("_below"), F.count(F.when(x <= m, 1))
                    .alias("_to")))
    half, slack = F.ceil(F.col("n") / 2), F.col("n") * rank_error(k)
    return ranks.select(*group, "n", "sketch_median",
                        ((F.col("_below") + 1 <= half + slack) & (F.col("_to") >= half - slack))
                        .alias("within_bound"))
