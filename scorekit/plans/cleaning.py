"""Cleaning job: scraped text rows -> typed, imputed, de-duplicated companies.

Steps (order matters: the median is taken before rows are dropped):

1. parse numbers: employee ranges, suffixed review counts, country from HQ
2. drop the raw review-count text
3. impute: global median employees; "Unknown" HQ/country; year 0
4. drop rows without name or rating
5. keep the first row per (Name, Headquarters) in file order (batch, pos)

Everything is a native expression; the median is a scalar subquery and the
de-duplication an aggregation (``min_by`` with map-side combine), so one
heavily duplicated key never needs to be gathered in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import country_of, employee_count, suffixed_count
from ..operators import median_table, row_positions
from ..schema import COMPANY_COLUMNS

# The imputation defaults of the cleaning job.
UNKNOWN = "Unknown"
MISSING_YEAR = 0
# The one positional correction of the scraped data (row 17, 0-based).
POINT_CORRECTIONS = {17: {"Headquarters": "Noida, Uttar Pradesh"}}

CLEAN_COLUMNS = ["Name", "Rating", "Headquarters", "Company_year", "Employees Count",
                 "RatingCount", "Country"]


def parse_fields(raw: DataFrame, on_error: str = "raise") -> DataFrame:
    """Typed numbers and the derived country; raw review-count text dropped."""
    return (raw.withColumn("Employees Count", employee_count("Employees Count").cast("double"))
               .withColumn("RatingCount", suffixed_count("Rating Count", on_error))
               .withColumn("Country", country_of("Headquarters"))
               .drop("Rating Count"))


def global_median(df: DataFrame, col: str) -> Column:
    """Exact median of a column over all rows, as a scalar subquery over the
    histogram of its values."""
    return median_table(df.select(col), [], col, "_median", label="global-median").scalar()


def impute_median(df: DataFrame, col: str = "Employees Count") -> DataFrame:
    """Fill NULLs with the exact global median (one scalar subquery)."""
    return df.withColumn(col, F.coalesce(F.col(col), global_median(df, col)))


def impute_constants(df: DataFrame) -> DataFrame:
    return (df.fillna({"Headquarters": UNKNOWN, "Country": UNKNOWN})
              .withColumn("Company_year",
                          F.coalesce(F.col("Company_year").try_cast("bigint"),
                                     F.lit(MISSING_YEAR).cast("bigint"))))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop duplicates on ``keys`` keeping the first row in ``order``.

    ``min_by`` over a struct of all columns is a partial aggregate: each map
    task reduces its duplicates before the shuffle.  NULL keys group together,
    as pandas ``drop_duplicates`` treats missing values as equal."""
    cols = df.columns
    return (df.groupBy(*keys)
              .agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_first"))
              .select("_first.*"))


def clean_companies(raw: DataFrame, on_error: str = "raise",
                    keys: Sequence[str] = ("Name", "Headquarters"),
                    order: Sequence[str] = ("batch", "pos"),
                    keep_order_columns: bool = False) -> DataFrame:
    df = parse_fields(raw, on_error)
    df = impute_median(df)
    df = impute_constants(df)
    df = df.withColumn("Rating", F.col("Rating").try_cast("double"))
    df = df.dropna(subset=["Name", "Rating"])
    df = keep_first(df, list(keys), list(order))
    cols = (list(order) if keep_order_columns else []) + CLEAN_COLUMNS
    return df.select(*cols)


def to_companies(clean: DataFrame, order: Sequence[str] = ("batch", "pos")) -> DataFrame:
    """Load the cleaned rows into the analysed table layout.

    ``id`` numbers rows 1..n in file order (an auto-increment key); numbers go
    to the integer columns rounded half up."""
    pos = row_positions(clean, [], [(c, "asc") for c in order], "id", "_n", label="load-ids")
    return pos.select(
        F.col("id").cast("long"), "Name", "Rating", "Headquarters",
        F.col("Company_year").cast("int"),
        F.floor(F.col("Employees Count") + 0.5).cast("int").alias("Employees_Count"),
        F.floor(F.col("RatingCount") + 0.5).cast("int").alias("RatingCount"),
        "Country").select(*COMPANY_COLUMNS)


def apply_point_corrections(df: DataFrame, corrections: Mapping[int, Mapping[str, str]]
                            = POINT_CORRECTIONS,
                            order: Sequence[str] = ("batch", "pos")) -> DataFrame:
    """Overwrite single cells addressed by 0-based row position in file order."""
    pos = row_positions(df, [], [(c, "asc") for c in order], "_row", "_n", label="fix-rows")
    pos = pos.withColumn("row_index", F.col("_row") - 1).drop("_row", "_n")
    cols: dict[str, Column] = {}
    for idx, fixes in corrections.items():
        for col, value in fixes.items():
            cur = cols.get(col, F.col(col))
            cols[col] = F.when(F.col("row_index") == idx, F.lit(value)).otherwise(cur)
    return pos.withColumns(cols)
