"""Group benchmarks and per-group top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_stored
from .positions import Order, group_positions, order_exprs


def group_stats(rows: DataFrame, group: Sequence[str], aggs: Sequence[Column],
                how: str = "inner", label: str = "bench") -> DataFrame:
    """Attach per-group aggregates to every row (``rows JOIN (GROUP BY) USING group``).

    The aggregate runs with map-side combine and is materialised once.  Rows whose group key is
    NULL do not match, as in an SQL equi-join."""
    stats = rows.groupBy(*group).agg(*aggs)
    return join_stored(rows, stats, list(group), how, label)


def topk_within(df: DataFrame, group: Sequence[str], order: Order, k: int,
                out_col: str, method: str = "row_number") -> DataFrame:
    """Rows with ``ROW_NUMBER()``/``RANK() <= k`` per group.

    The filter directly above the window lets Catalyst plan a partial
    ``WindowGroupLimit`` before the shuffle, so each map task ships at most the
    top ``k`` (plus ties) rows per group: a hot group never reaches one task
    whole."""
    spec = Window.partitionBy(*group).orderBy(*order_exprs(order)) if group \
        else Window.orderBy(*order_exprs(order))
    fn = {"row_number": F.row_number(), "rank": F.rank(), "dense_rank": F.dense_rank()}[method]
    return df.withColumn(out_col, fn.over(spec)).filter(F.col(out_col) <= k)


def group_median(df: DataFrame, group: Sequence[str], col: str, out_col: str = "median",
                 approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Per-group row count and median of ``col`` (mean of the two middle values).

    Exact by default (the histogram median of :func:`median_table`);
    ``approx=True`` uses ``percentile_approx`` (bounded sketch)."""
    group = list(group)
    rows = df.filter(F.col(col).isNotNull())
    if approx:
        return rows.groupBy(*group).agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx(F.col(col), 0.5, accuracy).cast("double").alias(out_col))
    med = median_table(rows, group, col, out_col)
    if not group:
        return med.select(rows.agg(F.count(F.lit(1))).scalar().alias("n"), out_col)
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    renamed = {g: f"_m{i}" for i, g in enumerate(group)}
    med = med.select(*[F.col(g).alias(a) for g, a in renamed.items()], out_col)
    cond = None
    for g, a in renamed.items():  # NULL keys form a group of their own
        e = F.col(g).eqNullSafe(F.col(a))
        cond = e if cond is None else cond & e
    return counts.join(med, cond).drop(*renamed.values())


def median_table(df: DataFrame, group: Sequence[str], col: str, out_col: str,
                 label: str = "median",
                 weight: str | None = None) -> DataFrame:
    """One row per group: the exact median of ``col`` (NULLs ignored).

    ``weight`` names an integer column giving each row's multiplicity (a
    histogram input); by default every row counts once.

    The (group, value) histogram is aggregated with map-side combine, its
    running counts come from the sort-based position operator, and the one or
    two histogram entries covering the middle positions give the median: no
    task ever holds a whole group or its whole set of distinct values."""
    group = list(group)
    rows = df.filter(F.col(col).isNotNull())
    freq = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    hist = rows.groupBy(*group, col).agg(F.sum(freq).alias("_cnt"))
    pos = group_positions(hist, group, [(col, "asc")], F.col("_cnt"), label)
    lo = F.floor((F.col("_total") - 1) / 2)
    hi = F.floor(F.col("_total") / 2)
    end = F.col("_before") + F.col("_cnt")
    covers_lo = (F.col("_before") <= lo) & (lo < end)
    covers_hi = (F.col("_before") <= hi) & (hi < end)
    picked = pos.filter(covers_lo | covers_hi)
    v = F.col(col).cast("double")
    return picked.groupBy(*group).agg(
        ((F.max(F.when(covers_lo, v)) + F.max(F.when(covers_hi, v))) / 2).alias(out_col))
