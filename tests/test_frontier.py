"""Crawled page ranges: islands, missing and repeated stretches against page sets."""

import random
from collections import Counter

import pytest

from scorekit.sources import frontier as R

SCHEMA = "site string, first long, last long"


def stretches(pages):
    out = []
    for p in sorted(pages):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(x) for x in out]


def pages_of(rows):
    return Counter(p for _, a, b in rows if a is not None and b is not None
                   for p in range(a, b + 1))


@pytest.fixture(scope="module")
def log():
    rng = random.Random(3)
    rows = [("s", a, a + rng.randrange(-2, 9)) for a in (rng.randrange(-20, 900) for _ in range(150))]
    rows += [("s", 40, 44), ("s", 45, 49), ("s", 45, 49), ("s", None, 5), ("s", 5, None),
             ("s", 300, 340), ("s", 300, 340)]
    return rows


def pairs(df):
    return sorted((r["first"], r["last"]) for r in df.collect())


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_islands(spark, log, depth):
    seen = pages_of(log)
    got = R.islands(spark.createDataFrame(log, SCHEMA), depth=depth)
    assert pairs(got) == stretches(p for p, n in seen.items() if n >= depth)
    assert sorted(r["island"] for r in got.collect()) == list(range(1, got.count() + 1))


@pytest.mark.parametrize("start, stop", [(1, 800), (-50, 2000), (42, 42), (10, 9), (305, 320)])
def test_missing_and_repeated(spark, log, start, stop):
    df, seen = spark.createDataFrame(log, SCHEMA), pages_of(log)
    wanted = range(start, stop + 1)
    assert pairs(R.missing_ranges(df, start, stop)) == stretches(p for p in wanted if not seen[p])
    assert pairs(R.repeated_ranges(df, start, stop)) == stretches(p for p in wanted if seen[p] > 1)


def test_groups(spark, log):
    rows = log + [("t", 1, 5), ("t", 3, 9), (None, 7, 8), (None, 10, 10)]
    got = R.islands(spark.createDataFrame(rows, SCHEMA), group=["site"])
    by_site = {}
    for r in got.collect():
        by_site.setdefault(r["site"], []).append((r["first"], r["last"]))
    assert by_site["t"] == [(1, 9)] and sorted(by_site[None]) == [(7, 8), (10, 10)]
    assert sorted(by_site["s"]) == stretches(pages_of(log))


def test_nothing_crawled(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pairs(R.missing_ranges(empty, 3, 7)) == [(3, 7)]
    assert pairs(R.islands(empty)) == [] and pairs(R.repeated_ranges(empty, 3, 7)) == []


def test_long_ranges_are_not_expanded(spark):
    df = spark.createDataFrame([("s", 1, 10 ** 15), ("s", 10 ** 15 + 2, 10 ** 16)], SCHEMA)
    assert pairs(R.missing_ranges(df, 1, 10 ** 16)) == [(10 ** 15 + 1, 10 ** 15 + 1)]


def test_urls(spark):
    df = spark.createDataFrame([("s", 3, 5)], SCHEMA)
    want = [(3, "u?p=3"), (4, "u?p=4"), (5, "u?p=5")]
    assert sorted(map(tuple, R.page_urls(df, "u?p=").collect())) == want
    assert sorted(map(tuple, R.url_range(spark, 3, 5, "u?p=").collect())) == want
