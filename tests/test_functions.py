"""Column helpers: edge cases of the cleaning rules, rounding and buckets."""

import pytest
from pyspark.sql import functions as F

from scorekit.functions import bucket_desc, bucket_range, exact_avg, field_position, minmax
from scorekit.functions import round_half_away
from scorekit.functions.text import country_of, employee_count, suffixed_count


def _map(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_employee_count_edge_cases(spark):
    cases = {"501-1k": 1000, "50k-1 lakh": 100000, "1 lakh+": 100000, "1 Lakh+": 100000,
             "1.5k": 1000, "500 workers": 500000, "0-10": None, "-5": None, "1-": None,
             "1,234": 1234, "unknown": None, "": None, None: None, " 12 ": 12,
             "10,001-50,000": 50000}
    got = _map(spark, list(cases), employee_count)
    assert got == list(cases.values())


def test_suffixed_count(spark):
    cases = {"3.1k": 3100.0, "1.2L": 120000.0, "950": 950.0, "2.3L": 230000.0, None: None,
             " 4K ": 4000.0, "12.1k": 12100.0}
    assert _map(spark, list(cases), suffixed_count) == list(cases.values())


def test_suffixed_count_bad_text(spark):
    assert _map(spark, ["x"], lambda c: suffixed_count(c, on_error="null")) == [None]
    with pytest.raises(Exception):
        _map(spark, ["x"], suffixed_count)


def test_country_of(spark):
    cases = {"Noida, Uttar Pradesh": "Uttar Pradesh", "A.. B.": "B",
             "X, United States of America": "USA", "...": None, "": None, None: None,
             "Bengaluru/Bangalore, Karnataka, India,": "India", "  Pune  ": "Pune"}
    assert _map(spark, list(cases), country_of) == list(cases.values())


def test_size_and_age_buckets(spark):
    size = bucket_desc(F.col("v"), ((2000, "Large"), (300, "Mid size")), "Startup/Small")
    assert _map(spark, [None, 300, 301, 2000, 2001], lambda c: size, "int") == [
        "Startup/Small", "Startup/Small", "Mid size", "Mid size", "Large"]
    age = bucket_range(F.col("v"), ((0, 5, "Startup"), (6, 15, "Growth"), (16, 30, "Established")),
                       "Legacy")
    assert _map(spark, [0, 5, 6, 15, 16, 30, 31, 2002], lambda c: age, "int") == [
        "Startup", "Startup", "Growth", "Growth", "Established", "Established", "Legacy",
        "Legacy"]


def test_round_half_away(spark):
    vals = [1.005, 2.5, -2.5, 0.125, -0.0004, None, 3.14159]
    got = _map(spark, vals, lambda c: round_half_away(c, 2), "double")
    assert got == [1.0, 2.5, -2.5, 0.13, 0.0, None, 3.14]
    assert _map(spark, [2.5, -2.5, 0.4], lambda c: round_half_away(c, 0), "double") == [
        3.0, -3.0, 0.0]
    # -0.0 never appears (hash-stable zero)
    assert str(_map(spark, [-0.0004], lambda c: round_half_away(c, 2), "double")[0]) == "0.0"


def test_exact_avg_is_order_independent(spark):
    rows = [(i % 3, [4.4, 3.3, 1.1, 2.2, 4.9][i % 5]) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, r double")
    a = {r[0]: r[1] for r in df.groupBy("g").agg(exact_avg("r", 1)).collect()}
    b = {r[0]: r[1] for r in df.repartition(13).groupBy("g").agg(exact_avg("r", 1)).collect()}
    assert a == b


def test_minmax_constant_group_is_zero(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    out = df.select(minmax("x", F.lit(1.0), F.lit(1.0)).alias("m")).collect()
    assert [r.m for r in out] == [0.0, 0.0]


def test_field_position(spark):
    order = ("Hidden Leader", "Popular Leader", "Average Performer")
    got = _map(spark, ["Popular Leader", "x", None, "Average Performer"],
               lambda c: field_position(c, order))
    assert got == [2, 0, 0, 3]


@pytest.mark.parametrize("values, scale, want", [
    ([float("nan"), 1.0], 9, "nan"), ([float("inf"), 1.0], 9, "inf"), ([1e30, 0.0], 9, "5e+29"),
    ([0.1] * 10, 9, "0.1"), ([None, 2.0, 4.0], 9, "3.0"), ([None], 9, "None"), ([], 9, "None"),
    ([1e-12, 1e-12], 9, "0.0"), ([9e28] * 20, 9, "9e+28")])
def test_exact_avg_of_numbers_without_a_decimal_form(spark, values, scale, want):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.agg(exact_avg("x", scale).alias("a")).first()["a"]
    assert str(got) == want or got == pytest.approx(float(want), rel=1e-12)
