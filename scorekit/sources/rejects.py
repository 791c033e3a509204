"""Tolerant loading: rows that cannot be used are set aside with a reason.

One pass reads the text, parses every line and tests every row against rules; its result
is written once, split by ``_reason IS NULL``, so accepted and rejected rows always add up
to the lines of the input.  A rule is a reason and a condition under which a row is
refused; the first that holds gives the row's reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import suffixed_count
from ..schema import COMPANIES_RAW
from ..session import materialize

LINE = "_line"
REASON = "_reason"
MALFORMED = "malformed line"
Rule = tuple[str, Column]

# The declared text lengths of the analysed table.
TEXT_LENGTHS = {"Name": 255, "Headquarters": 255}


def unparseable(column: str, parsed: Column) -> Rule:
    """Refuse a text that has no parsed value."""
    return f"{column}: not a number", F.col(column).isNotNull() & parsed.isNull()


def too_long(lengths: Mapping[str, int]) -> list[Rule]:
    """Refuse texts longer than a VARCHAR column takes."""
    return [(f"{c}: over {n} characters", F.length(c) > n) for c, n in lengths.items()]


def company_rules() -> list[Rule]:
    """What the cleaning and loading jobs cannot take from a scraped row."""
    return [unparseable("Rating Count", suffixed_count("Rating Count", "null")),
            unparseable("Rating", F.col("Rating").try_cast("double")),
            *too_long(TEXT_LENGTHS)]


def with_line(schema: StructType = COMPANIES_RAW) -> StructType:
    """``schema`` with the column that receives a line that does not fit it."""
    return StructType([*schema.fields, StructField(LINE, StringType())])


def csv_options(header: bool = True) -> dict:
    # without pruning a line is parsed whole whatever columns are asked for
    return {"header": str(header).lower(), "mode": "PERMISSIVE", "columnPruning": "false",
            "columnNameOfCorruptRecord": LINE}


def with_reason(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` (with ``_line``, if they come from text) and the reason to refuse each."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        reason = F.when(bad, name).otherwise(reason)
    if LINE in rows.columns:
        reason = F.when(F.col(LINE).isNotNull(), MALFORMED).otherwise(reason)
    return rows.withColumn(REASON, reason)


def split(rows: DataFrame, rules: Sequence[Rule], label: str = "load") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; the rejected rows have ``_reason`` and, from text, ``_line``.
    Both come from one written table."""
    tested = materialize(with_reason(rows, rules), label)
    extra = [c for c in (LINE, REASON) if c in tested.columns]
    return tested.where(F.col(REASON).isNull()).drop(*extra), tested.where(F.col(REASON).isNotNull())


def load_csv(spark: SparkSession, path: str, schema: StructType = COMPANIES_RAW,
             rules: Sequence[Rule] | None = None, header: bool = True
             ) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` rows of a CSV folder.  A line whose fields do not fit the
    schema is rejected with its text; the fields that could be read stay beside it."""
    rows = spark.read.schema(with_line(schema)).options(**csv_options(header)).csv(path)
    return split(rows, company_rules() if rules is None else rules, "csv-load")
