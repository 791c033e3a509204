"""Cleaning job semantics on hand-made raw rows."""

from pyspark.sql import functions as F

from scorekit.plans import cleaning as C
from scorekit.plans import quality as Q
from scorekit.schema import COMPANIES_RAW


def _raw(spark, rows):
    return spark.createDataFrame(rows, COMPANIES_RAW)


ROWS = [
    # batch, pos, Name, Rating, Rating Count, Headquarters, Company_year, Employees Count
    (1, 1, "Acme", "4.1", "3.1k", "Noida, Uttar Pradesh", "1999", "501-1k"),
    (1, 2, "Beta", "3.9", "1.2L", None, None, None),
    (1, 3, "Gamma", None, "950", "Pune, Maharashtra", "2005", "1 lakh+"),
    (1, 4, None, "4.0", "10", "X, United States of America", "2010", "0-10"),
    (2, 2, "Beta", "3.0", "5", None, "2001", "1,234"),      # duplicate of (1, 2): dropped
    (2, 5, "Acme", "2.0", "7", "Noida, Uttar Pradesh", None, "50k-1 lakh"),  # duplicate
    (2, 6, "Delta", "3.3", "2.3L", "A.. B.", "1980", "unknown"),
]


def test_clean_companies_end_to_end(spark):
    out = {r.Name: r for r in C.clean_companies(_raw(spark, ROWS), keep_order_columns=True)
           .collect()}
    assert set(out) == {"Acme", "Beta", "Delta"}           # NULL name / rating dropped
    assert (out["Acme"].batch, out["Acme"].pos) == (1, 1)  # keep first in file order
    assert (out["Beta"].batch, out["Beta"].pos) == (1, 2)
    assert out["Beta"].Headquarters == "Unknown" and out["Beta"].Country == "Unknown"
    assert out["Beta"].Company_year == 0
    assert out["Acme"].RatingCount == 3100.0 and out["Delta"].RatingCount == 230000.0
    assert out["Delta"].Country == "B"
    # median over ALL rows before dropping: employees 1000, 100000, 1234, 100000 -> 50617.0
    assert out["Acme"]["Employees Count"] == 1000.0         # "501-1k" -> upper bound
    assert out["Beta"]["Employees Count"] == 50617.0        # kept Beta row had none -> median
    assert out["Delta"]["Employees Count"] == 50617.0       # 'unknown' -> median


def test_median_is_taken_before_rows_are_dropped(spark):
    raw = _raw(spark, ROWS)
    med = C.parse_fields(raw).agg(F.percentile("Employees Count", 0.5)).first()[0]
    assert med == 50617.0


def test_point_corrections_by_position(spark):
    rows = [(1, i, f"N{i}", "4.0", "1", f"HQ{i}", None, None) for i in range(30)]
    out = {r.row_index: r.Headquarters
           for r in C.apply_point_corrections(_raw(spark, rows)).collect()}
    assert out[17] == "Noida, Uttar Pradesh" and out[16] == "HQ16" and out[18] == "HQ18"


def test_null_profile(spark):
    prof = {r.column_name: r for r in Q.null_profile(_raw(spark, ROWS), ["Name", "Rating"])
            .collect()}
    assert prof["Name"].null_count == 1 and prof["Rating"].null_count == 1
    assert abs(prof["Name"].null_pct - 100 / 7) < 1e-9 and prof["Name"].row_count == 7


def test_to_companies_ids_follow_file_order(spark):
    clean = C.clean_companies(_raw(spark, ROWS), keep_order_columns=True)
    ids = {r.Name: r.id for r in C.to_companies(clean).collect()}
    assert ids == {"Acme": 1, "Beta": 2, "Delta": 3}


def test_quality_checks(spark):
    df = _raw(spark, ROWS)
    assert Q.duplicate_keys(df, ["Name"]).count() == 2
    assert Q.over_length(df, {"Name": 4}).count() == 2
    assert Q.shape(df) == (7, 8)
