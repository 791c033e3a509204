"""Native column expressions for messy scraped text (no Python UDFs).

* ``unit_number``      first digit run, x100000 for "lakh", x1000 for "k"
* ``employee_count``   ranges take the larger bound, only if both are non-zero
* ``suffixed_count``   "3.1k" / "1.2L" / "950" -> exact value (decimal arithmetic)
* ``country_of``       last non-empty comma/dot separated part, "United States..." -> "USA"
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit words and multipliers of the scraped counts.
LAKH_WORD = "lakh"
THOUSAND_LETTER = "k"
LAKH = 100000
THOUSAND = 1000
US_MARKER = "United States"
US_NAME = "USA"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace (Spark ``trim`` only drops spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def unit_number(c) -> Column:
    """First run of digits, scaled by the unit word; NULL when there are no digits."""
    t = _c(c)
    digits = F.regexp_extract(t, r"(\d+)", 1)
    num = F.when(digits != "", digits.try_cast("bigint"))
    mult = (F.when(t.contains(LAKH_WORD), F.lit(LAKH))
             .when(t.contains(THOUSAND_LETTER), F.lit(THOUSAND))
             .otherwise(F.lit(1)))
    return F.try_multiply(num, mult.cast("bigint"))


def employee_count(c) -> Column:
    """Clean an employee-count text: ``"501-1k"`` -> 1000, ``"1 lakh+"`` -> 100000.

    Empty/NULL -> NULL.  Lower-cased, commas removed.  A range keeps its upper
    bound only when every part has a non-zero number (``"0-10"`` -> NULL)."""
    t = _c(c)
    t0 = strip_ws(F.replace(F.lower(t), F.lit(","), F.lit("")))
    vals = F.transform(F.split(t0, "-", -1), unit_number)
    all_set = F.forall(vals, lambda v: v.isNotNull() & (v != 0))
    return (F.when(t.isNull() | (t == ""), F.lit(None).cast("bigint"))
             .when(t0.contains("-"), F.when(all_set, F.array_max(vals)))
             .otherwise(unit_number(t0)))


def suffixed_count(c, on_error: str = "raise") -> Column:
    """``"3.1k"`` -> 3100.0, ``"1.2L"`` -> 120000.0, ``"950"`` -> 950.0 (double).

    Upper-cased; a ``L`` (lakh) or else ``K`` is removed and scales the number.
    The arithmetic is decimal, so ``"2.3L"`` is exactly 230000.  Unparseable
    text raises (``on_error="raise"``, ANSI cast) or yields NULL (``"null"``)."""
    u = F.upper(strip_ws(_c(c)))
    has_l, has_k = u.contains("L"), u.contains("K")
    text = strip_ws(F.when(has_l, F.replace(u, F.lit("L"), F.lit("")))
                     .when(has_k, F.replace(u, F.lit("K"), F.lit("")))
                     .otherwise(u))
    kind = "decimal(28,10)"
    num = text.cast(kind) if on_error == "raise" else text.try_cast(kind)
    mult = F.when(has_l, F.lit(LAKH)).when(has_k, F.lit(THOUSAND)).otherwise(F.lit(1))
    return (num * mult.cast("decimal(6,0)")).cast("double")


def country_of(c) -> Column:
    """Country = last non-empty part of a location split on commas and dot runs.

    Parts mentioning "United States" become "USA"; text without any part
    gives NULL."""
    hq = _c(c)
    parts = F.filter(F.transform(F.split(F.regexp_replace(strip_ws(hq), r"\.+", ","), ",", -1),
                                 strip_ws), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(last.contains(US_MARKER), F.lit(US_NAME)).otherwise(last)
