"""Numeric column helpers shared by all analyses.

Rounding and averaging are spelled out explicitly so that every engine that
evaluates the same formula (Spark here, DuckDB in the oracle) produces the
same IEEE doubles:

* ``exact_avg`` sums in exact integer/decimal arithmetic, converts the sum to
  double once and divides by the count, so the result does not depend on the
  order in which partial sums are combined.
* ``round_half_away`` rounds half away from zero with ``floor`` on doubles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c, digits: int) -> Column:
    """ROUND(x, digits), halves away from zero; NULL stays NULL. Returns double."""
    x = _c(c)
    p = float(10 ** digits)
    pos = F.floor(x * p + 0.5) / p
    neg = (F.lit(0) - F.floor(-x * p + 0.5)) / p
    return F.when(x < 0, neg).otherwise(pos)


#: Decimals that an exact sum keeps of each value; 29 digits are left of the point.
SUM_SCALE = 9


def exact_sum(c, scale: int = SUM_SCALE) -> Column:
    """SUM(x) in decimal arithmetic, so partial sums combine in any order.

    Each value is rounded to ``scale`` decimals.  A value that does not fit (NaN,
    infinite, 1e29 or more) raises an error in ANSI mode."""
    return F.sum(_c(c).cast(DecimalType(38, scale)))


def exact_avg(c, scale: int = SUM_SCALE) -> Column:
    """AVG(x) with an exact sum: ``double(sum(decimal(x))) / count(x)``.

    ``scale`` is the number of decimals kept of each value (0 for whole
    numbers), so with the default values below 5e-10 count as 0.  If a value has no
    decimal form (NaN, infinite, 1e29 or more) or the sum has none, the result is the
    plain average of doubles: NaN and infinity come through.  Aggregate expression; use
    inside ``agg``.
    """
    x = _c(c)
    exact = x.try_cast(DecimalType(38, scale))
    total = F.try_sum(exact)
    fits = (F.count(exact) == F.count(x)) & total.isNotNull()
    return F.when(fits, total.cast("double") / F.nullif(F.count(x), F.lit(0))).otherwise(
        F.avg(x.cast("double")))


def nullsafe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)`` (ANSI mode would raise on a zero divisor)."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def minmax(x, lo, hi) -> Column:
    """Min-max scale: ``coalesce((x-lo)/nullif(hi-lo,0), 0)``; constant group -> 0."""
    x, lo, hi = _c(x), _c(lo), _c(hi)
    return F.coalesce((x - lo) / F.nullif(hi - lo, F.lit(0)), F.lit(0.0))


def weighted(parts: Mapping[float, Column] | list[tuple[float, Column]]) -> Column:
    """Weighted sum ``w1*c1 + w2*c2 + ...`` evaluated left to right."""
    items = list(parts.items()) if isinstance(parts, Mapping) else list(parts)
    total = None
    for w, col in items:
        term = F.lit(float(w)) * _c(col)
        total = term if total is None else total + term
    return total


def bayesian_score(score, weight, prior_mean, prior_weight) -> Column:
    """Credibility-weighted rating ``n/(n+m)*R + m/(n+m)*C``."""
    r, n, c, m = _c(score), _c(weight), _c(prior_mean), _c(prior_weight)
    return (n / F.nullif(n + m, F.lit(0))) * r + (m / F.nullif(n + m, F.lit(0))) * c


def rank_score(rank, n) -> Column:
    """Convert a 1-based rank among ``n`` into a score in (0, 1]: ``(n-rank+1)/n``."""
    return (_c(n) - _c(rank) + 1) / _c(n)
