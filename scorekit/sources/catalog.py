"""Database and typed table definitions in the Spark catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COMPANY_COLUMNS

# The analysed table's DDL (string lengths as declared).
COMPANIES_DDL = """(
    id BIGINT,
    Name VARCHAR(255),
    Rating DOUBLE,
    Headquarters VARCHAR(255),
    Company_year INT,
    Employees_Count INT,
    RatingCount INT,
    Country VARCHAR(100)
)"""


def use_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the database if needed (its tables go under ``location``) and make it current."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{place}")
    spark.catalog.setCurrentDatabase(name)


def create_companies_table(spark: SparkSession, table: str = "companies",
                           replace: bool = False) -> None:
    """Create the typed table (Parquet); VARCHAR lengths are checked on insert."""
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} {COMPANIES_DDL} USING parquet")


def load_companies(df: DataFrame, table: str = "companies", overwrite: bool = True) -> None:
    """Insert rows (cast to the table's columns, in its order) into the table."""
    cols = [F.col(c) for c in COMPANY_COLUMNS]
    df.select(*cols).write.insertInto(table, overwrite=overwrite)
