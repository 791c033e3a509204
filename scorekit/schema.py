"""Explicit schemas of the entity tables (no inference anywhere)."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# The analysed table: one row per rated entity.
COMPANIES = StructType([
    StructField("id", LongType()),
    StructField("Name", StringType()),
    StructField("Rating", DoubleType()),
    StructField("Headquarters", StringType()),
    StructField("Company_year", IntegerType()),
    StructField("Employees_Count", IntegerType()),
    StructField("RatingCount", IntegerType()),
    StructField("Country", StringType()),
])

# Scraped text before cleaning, one row per card, with its batch and position
# (the order a CSV append would have written it in).
COMPANIES_RAW = StructType([
    StructField("batch", IntegerType()),
    StructField("pos", LongType()),
    StructField("Name", StringType()),
    StructField("Rating", StringType()),
    StructField("Rating Count", StringType()),
    StructField("Headquarters", StringType()),
    StructField("Company_year", StringType()),
    StructField("Employees Count", StringType()),
])

# Cleaned CSV layout (raw columns after cleaning; RatingCount replaces "Rating Count").
COMPANIES_CLEAN = StructType([
    StructField("Name", StringType()),
    StructField("Rating", DoubleType()),
    StructField("Headquarters", StringType()),
    StructField("Company_year", LongType()),
    StructField("Employees Count", DoubleType()),
    StructField("RatingCount", DoubleType()),
    StructField("Country", StringType()),
])

COMPANY_COLUMNS = [f.name for f in COMPANIES.fields]
