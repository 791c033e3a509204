"""Page ranges of a crawl: what is covered, what is still to fetch, what came twice.

A crawl log holds ranges ``first..last`` of page numbers, many of them and overlapping.
They are never expanded into pages.  Every range adds 1 to the depth at its first page
and takes 1 off behind its last; boundaries at one page are summed (in each task, before
they shuffle), and the running sum over the sorted boundaries, from
:func:`group_positions`, is the depth up to the next boundary.  An island is a stretch
of at least a given depth: it starts and ends where the depth crosses that mark.  The
crossings are numbered in order; the odd ones start an island, the even ones end it, and
what lies between an even one and the next is a gap.

Ranges whose ``first`` or ``last`` is NULL, or whose ``last`` is before ``first``, cover
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import group_positions, row_positions


def _crossings(ranges: DataFrame, first: str, last: str, depth: int, group: Sequence[str],
               label: str) -> DataFrame:
    """``group..., _row, _page``: the pages from which on the depth is at least ``depth`` (odd
    ``_row``), or no longer (even ``_row``), numbered in order."""
    steps = F.array(F.struct(F.col(first).cast("long").alias("_page"),
                             F.lit(1).cast("long").alias("_step")),
                    F.struct((F.col(last).cast("long") + 1).alias("_page"),
                             F.lit(-1).cast("long").alias("_step")))
    edges = (ranges.where(F.col(first) <= F.col(last))
             .select(*group, F.explode(steps).alias("_e")).select(*group, "_e.*")
             .groupBy(*group, "_page").agg(F.sum("_step").alias("_step")).where("_step != 0"))
    depths = group_positions(edges, group, [("_page", "asc")], F.col("_step"), label)
    over = F.col("_before") + F.col("_step") >= depth
    crossed = depths.where(over != (F.col("_before") >= depth)).select(*group, "_page")
    # a depth rises above the mark and falls below it in turn
    return row_positions(crossed, group, [("_page", "asc")], "_row", "_n",
                         label + "-crossings").drop("_n")


def islands(ranges: DataFrame, first: str = "first", last: str = "last", depth: int = 1,
            group: Sequence[str] = (), label: str = "islands") -> DataFrame:
    """``group..., island, first, last``: maximal stretches of pages that at least ``depth``
    ranges cover, numbered from 1 in each group."""
    rows = _crossings(ranges, first, last, depth, list(group), label)
    return rows.groupBy(*group, F.expr("(_row + 1) div 2").alias("island")).agg(
        F.min("_page").alias("first"), (F.max("_page") - 1).alias("last"))


def missing_ranges(ranges: DataFrame, start: int, stop: int, first: str = "first",
                   last: str = "last") -> DataFrame:
    """``first, last``: maximal stretches of the pages ``start..stop`` that no range covers.

    The pages on both sides of the bounds are taken as covered; what lies between the end
    of one island and the start of the next is missing."""
    inside = ranges.where(F.col(first) <= F.col(last)).select(
        F.greatest(F.col(first).cast("long"), F.lit(start)).alias("first"),
        F.least(F.col(last).cast("long"), F.lit(stop)).alias("last"))
    edges = ranges.sparkSession.createDataFrame(
        [(start - 1, start - 1), (max(start, stop + 1),) * 2], "first long, last long")
    rows = _crossings(inside.unionByName(edges), "first", "last", 1, [], "covered")
    return rows.groupBy(F.expr("_row div 2").alias("_gap")).agg(
        F.min("_page").alias("first"), (F.max("_page") - 1).alias("last"),
        F.count(F.lit(1)).alias("_n")).where("_n = 2").select("first", "last")


def repeated_ranges(ranges: DataFrame, start: int, stop: int, first: str = "first",
                    last: str = "last") -> DataFrame:
    """``first, last``: maximal stretches of ``start..stop`` that two or more ranges cover."""
    inside = ranges.where(F.col(first) <= F.col(last)).select(
        F.greatest(F.col(first), F.lit(start)).alias("first"),
        F.least(F.col(last), F.lit(stop)).alias("last"))
    return islands(inside, depth=2, label="repeated").select("first", "last")


def page_urls(ranges: DataFrame, url: str, first: str = "first", last: str = "last") -> DataFrame:
    """``page, url`` of every page of the ranges."""
    return ranges.select(F.explode(F.sequence(first, last)).alias("page")).select(
        "page", F.concat(F.lit(url), F.col("page").cast("string")).alias("url"))


def url_range(spark: SparkSession, start: int, stop: int, url: str) -> DataFrame:
    """``page, url`` of the pages ``start..stop``."""
    return spark.range(start, stop + 1).select(
        F.col("id").alias("page"), F.concat(F.lit(url), F.col("id").cast("string")).alias("url"))
