"""CSV/Parquet IO for scraped and cleaned company rows.

* ``read_csv``        header CSV with an explicit schema (never inferred)
* ``append_csv``      add a crawl batch to a CSV folder (each part file has its header)
* ``write_clean``     overwrite a cleaned table, refusing to overwrite its own input
                      (Spark reads lazily, so an in-place overwrite would lose rows)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..schema import COMPANIES_RAW


def read_csv(spark: SparkSession, path: str, schema: StructType = COMPANIES_RAW) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
                 .csv(path))


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def _norm(p: str) -> str:
    p = p[len("file:"):] if p.startswith("file:") else p
    return os.path.normpath(p).rstrip("/")


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    target = _norm(path)
    for f in df.inputFiles():
        src = _norm(f)
        if src == target or src.startswith(target + "/"):
            raise ValueError(f"refusing to overwrite {path}: the result is read from it")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def normalize_layout(df: DataFrame) -> DataFrame:
    """Map the earlier 5-column scrape layout (``Founded Year``, no employees)
    onto the 6-column layout: ``Founded Year`` -> ``Company_year`` and a NULL
    ``Employees Count``; other layouts pass through unchanged."""
    from pyspark.sql import functions as F
    if "Founded Year" in df.columns:
        df = df.withColumnRenamed("Founded Year", "Company_year")
    if "Employees Count" not in df.columns:
        df = df.withColumn("Employees Count", F.lit(None).cast("string"))
    return df
