"""Native text cleaners: literal cases and properties over generated text."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorekit.functions.text import country_of, employee_count, suffixed_count

EMPLOYEES = {
    None: None, "": None, "unknown": None, "12": 12, "1,234": 1234, " 501-1k ": 1000,
    "10k-50k": 50000, "50k-1 lakh": 100000, "1 Lakh+": 100000, "0-10": None, "5-": None,
    "-": None, "1k Employees": 1000, "200-50": 200, "7-x": None, "lakh": None,
    "9999999999999999999": None, "9223372036854775807": 9223372036854775807,
    "9223372036854775807k": None, "1-2-3": 3, "3K": 3000,
}
COUNTS = {
    None: None, "950": 950.0, "3.1k": 3100.0, "3.1K ": 3100.0, "2.3L": 230000.0, " 1.2l": 120000.0,
    "1.5 K": 1500.0, "abc": None, "": None, "k": None, "0.1234567k": 123.4567,
    "1234567890123456": 1234567890123456.0, "1KL": None,
}
COUNTRIES = {
    None: None, "": None, "...": None, "India": "India", "Pune, India": "India",
    "Noida.. Uttar Pradesh": "Uttar Pradesh", "x, United States of America": "USA",
    "United States, India": "India", " Pune ,, ": "Pune", "a.b.c": "c", "Delhi, India.": "India",
}


def _run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize("fn,cases", [
    (employee_count, EMPLOYEES), (lambda c: suffixed_count(c, on_error="null"), COUNTS),
    (country_of, COUNTRIES)])
def test_literal_cases(spark, fn, cases):
    assert dict(zip(cases, _run(spark, list(cases), fn))) == cases


SET = settings(max_examples=4, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture])
NUMBER = st.integers(1, 9_999_999)


@SET
@given(st.lists(st.tuples(NUMBER, NUMBER), min_size=1, max_size=30))
def test_a_range_keeps_its_upper_end(spark, pairs):
    texts = [f"{a:,}-{b:,} employees" for a, b in pairs]
    assert _run(spark, texts, employee_count) == [max(p) for p in pairs]


@SET
@given(st.lists(NUMBER, min_size=1, max_size=30))
def test_units_scale(spark, numbers):
    plain, k, lakh = (_run(spark, [f"{n}{u}" for n in numbers], employee_count)
                      for u in ("", "k", " lakh"))
    assert plain == numbers
    assert k == [n * 1000 for n in numbers] and lakh == [n * 100_000 for n in numbers]
    assert _run(spark, [f" {n}k" for n in numbers], suffixed_count) == [n * 1000.0 for n in numbers]


PLACE = st.text(alphabet="abc ABC", min_size=1, max_size=8).filter(str.strip)


@SET
@given(st.lists(st.lists(PLACE, min_size=1, max_size=4), min_size=1, max_size=30),
       st.sampled_from([", ", "..", " ,", ",,"]))
def test_the_last_part_is_the_country(spark, places, separator):
    texts = [separator.join(p) for p in places]
    assert _run(spark, texts, country_of) == [p[-1].strip() for p in places]
