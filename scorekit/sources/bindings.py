"""Bindings of the entity tables onto the TPC-H-style test data.

``companies``        one row per customer (the analysed table)
``companies_fine``   the same with ratings of two decimals
``companies_raw``    the same customers as scraped text, in two overlapping batches
``entities_orders``  one row per order: a 10x larger table with the same columns

Every binding is a lazy plan over the given Parquet tables, so its work grows
with the data.  Large-side aggregates are computed before the joins
(``lineitem`` collapses to one row per order before meeting ``orders``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COMPANY_COLUMNS
from ..session import materialize, session_key
from .tables import read_table

_STORED: dict = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The binding ``name`` written once per session as a Parquet table (the
    stored ``companies`` table the analyses query), then read back."""
    import os
    key = (session_key(spark), os.path.abspath(sf_dir), name)
    if key not in _STORED:
        build = {"companies": companies, "companies_raw": companies_raw,
                 "companies_fine": companies_fine, "entities_orders": entities_orders,
                 "companies_clean": companies_clean, "scraped_fields": scraped_fields}[name]
        _STORED[key] = materialize(build(spark, sf_dir), name)
    return _STORED[key]


def companies_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scraped rows after the cleaning job, loaded into the companies layout."""
    from ..plans.cleaning import clean_companies, to_companies
    raw = stored(spark, sf_dir, "companies_raw")
    return to_companies(clean_companies(raw, keep_order_columns=True))


def forget_stored(spark: SparkSession) -> None:
    """Drop this session's stored-table handles (their files were released)."""
    key = session_key(spark)
    for k in [k for k in _STORED if k[0] == key]:
        del _STORED[k]


def _nation(spark, sf_dir):
    # TPC-H fixes nation at 25 rows, so broadcasting it is size-bounded by spec.
    return F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


def customer_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: number of orders ``n`` and total line quantity ``q``."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_order = (read_table(spark, sf_dir, "lineitem")
                 .groupBy("l_orderkey").agg(F.sum("l_quantity").alias("order_qty")))
    return (orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
                  .groupBy("o_custkey")
                  .agg(F.count(F.lit(1)).alias("n"), F.sum("order_qty").alias("q")))


def _rating_digits(acctbal):
    return F.lit(10) + F.floor((acctbal + 1000) / 275)


def _company_year(k):
    return (F.when(k % 29 == 0, F.lit(0))
             .when(k % 97 == 0, F.lit(2003))
             .when(k % 31 == 0, F.lit(None))
             .otherwise(F.lit(2002) - k % 45)).cast("int")


def companies_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``companies`` with ratings of two decimals."""
    digits = F.round(F.col("Rating") * 100) + (F.col("id") - 1) % 10
    return companies(spark, sf_dir).withColumn("Rating", digits / F.lit(100.0))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    act = customer_activity(spark, sf_dir)
    k = F.col("c_custkey")
    df = (cust.join(_nation(spark, sf_dir), cust.c_nationkey == F.col("n_nationkey"))
              .join(act, k == act.o_custkey, "left"))
    return df.select(
        (k + 1).cast("long").alias("id"),
        F.col("c_name").alias("Name"),
        F.when(k % 41 == 0, F.lit(None))
         .otherwise(_rating_digits(F.col("c_acctbal")).cast("double") / F.lit(10.0))
         .alias("Rating"),
        F.concat(F.col("c_mktsegment"), F.lit(", "), F.col("n_name")).alias("Headquarters"),
        _company_year(k).alias("Company_year"),
        F.when(k % 37 == 0, F.lit(None))
         .otherwise(F.floor(F.col("q") * F.col("q") / 1000)).cast("int").alias("Employees_Count"),
        F.when(k % 43 == 0, F.lit(None))
         .otherwise(F.col("n") * F.col("n") * 100).cast("int").alias("RatingCount"),
        F.when(k % 53 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("Country"),
    ).select(*COMPANY_COLUMNS)


def entities_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities (same columns as ``companies``), for scale runs."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    lines = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("lines")))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    df = (orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
                .join(_nation(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"), "left")
                .join(lines, orders.o_orderkey == lines.l_orderkey, "left"))
    return df.select(
        F.col("o_orderkey").cast("long").alias("id"),
        F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("Name"),
        ((F.lit(10) + F.floor(F.col("o_totalprice") / 12500)).cast("double")
         / F.lit(10.0)).alias("Rating"),
        F.col("o_orderpriority").alias("Headquarters"),
        F.year("o_orderdate").cast("int").alias("Company_year"),
        F.col("qty").cast("int").alias("Employees_Count"),
        F.col("lines").cast("int").alias("RatingCount"),
        F.col("n_name").alias("Country"),
    ).toDF(*COMPANY_COLUMNS)


def scraped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scraped-text row per customer (``pos`` = customer key)."""
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    act = customer_activity(spark, sf_dir)
    k = F.col("c_custkey")
    n = F.col("n")
    d = _rating_digits(F.col("c_acctbal")).cast("long")
    seg, nat = F.col("c_mktsegment"), F.col("n_name")
    year = _company_year(k)
    base = (cust.join(_nation(spark, sf_dir), cust.c_nationkey == F.col("n_nationkey"))
                .join(act, k == act.o_custkey, "left"))
    fields = base.select(
        k.alias("pos"),
        F.when(k % 61 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("Name"),
        F.when(k % 41 == 0, F.lit(None))
         .otherwise(F.concat((d / 10).cast("long").cast("string"), F.lit("."),
                             (d % 10).cast("string"))).alias("Rating"),
        F.when(k % 43 == 0, F.lit(None))
         .when(k % 7 == 0, F.concat(n.cast("string"), F.lit(".3L")))
         .when(k % 7 < 4, F.concat(n.cast("string"), F.lit(".1k")))
         .otherwise((n * 10).cast("string")).alias("Rating Count"),
        F.when(k % 47 == 0, F.lit(None))
         .when(k % 5 == 0, F.concat(seg, F.lit(".. "), nat))
         .when(k % 5 == 1, F.concat(seg, F.lit(", United States of America")))
         .when(k % 53 == 0, F.lit("..."))
         .otherwise(F.concat(seg, F.lit(", "), nat, F.lit(","))).alias("Headquarters"),
        F.when(year == 0, F.lit(None)).otherwise(year.cast("string")).alias("Company_year"),
        F.when(k % 37 == 0, F.lit(None))
         .when(k % 6 == 0, F.concat(n.cast("string"), F.lit("01-"), (n + 1).cast("string"), F.lit("k")))
         .when(k % 6 == 1, F.lit("50k-1 lakh"))
         .when(k % 6 == 2, F.lit("1 Lakh+"))
         .when(k % 6 == 3, F.lit("0-10"))
         .when(k % 6 == 4, F.concat(F.lit("1,"), (n + 100).cast("string")))
         .otherwise(F.lit("unknown")).alias("Employees Count"),
    )
    return fields


def companies_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped-text layout in two overlapping batches (rows with k % 3 = 2 are in both)."""
    fields = stored(spark, sf_dir, "scraped_fields")
    b1 = fields.filter(F.col("pos") % 3 != 0).withColumn("batch", F.lit(1))
    b2 = fields.filter(F.col("pos") % 3 != 1).withColumn("batch", F.lit(2))
    cols = ["batch", "pos", "Name", "Rating", "Rating Count", "Headquarters",
            "Company_year", "Employees Count"]
    return b1.select(*cols).unionByName(b2.select(*cols))
