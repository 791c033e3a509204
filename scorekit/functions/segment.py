"""Threshold bucketing and custom sort keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_desc(c, cuts: Sequence[tuple[float, str]], other: str) -> Column:
    """First matching ``x > cut`` label, else ``other`` (NULL input -> ``other``)."""
    x = _c(c)
    expr = None
    for cut, label in cuts:
        expr = F.when(x > cut, label) if expr is None else expr.when(x > cut, label)
    return expr.otherwise(other) if expr is not None else F.lit(other)


def bucket_range(c, ranges: Sequence[tuple[float, float, str]], other: str) -> Column:
    """First matching ``lo <= x <= hi`` label, else ``other``."""
    x = _c(c)
    expr = None
    for lo, hi, label in ranges:
        cond = x.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(other) if expr is not None else F.lit(other)


def field_position(c, values: Sequence[str]) -> Column:
    """MySQL ``FIELD(x, v1, v2, ...)``: 1-based position, 0 when absent or NULL."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), _c(c)), F.lit(0))
