"""Rows at positions: tiles, medians and borders against sorted lists and native windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorekit.operators import selection as S
from scorekit.operators.positions import order_exprs, ranks_within
from scorekit.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    """9,000 rows: a group of two thirds, small ones, a NULL one; ties, NULLs, NaN, -0.0."""
    rng = random.Random(5)
    out = []
    for i in range(9000):
        g = "hot" if i % 3 else [None, "a", "b", "c" + str(i % 60)][i % 4]
        x = [None, float("nan"), -0.0, 0.0, rng.choice([1.5, 2.5]), rng.gauss(0, 9)][
            min(5, rng.randrange(12))]
        out.append((i, g, x, rng.choice([None, 1, 2, 2 ** 60, 2 ** 60 + 1]), f"n{i % 7}"))
    return materialize(spark.createDataFrame(
        out, "id long, g string, x double, big long, name string"), "rows")


ORDERS = [
    [("x", "asc"), ("id", "asc")],
    [("x", "desc"), ("name", "asc"), ("id", "desc")],
    [("big", "desc"), ("x", "asc"), ("id", "asc")],
    [("name", "asc"), ("id", "asc")],  # text: no image, every entry is kept
]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("group", [["g"], []])
@pytest.mark.parametrize("k", [2, 7])
def test_tiles_equal_ntile(rows, order, group, k):
    cuts = S.tile_ends("t", order, k)
    got = S.with_cuts(rows, group, [cuts]).withColumn("tile", S.tile_of(cuts, k))
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
        *order_exprs(order))
    want = rows.withColumn("tile", F.ntile(k).over(w))
    assert sorted(map(tuple, got.select("id", "tile").collect())) == sorted(
        map(tuple, want.select("id", "tile").collect()))


def test_several_orders_in_one_round(rows):
    base = rows.where("x is not null and not isnan(x)")
    cuts = [S.middle("mid", "x"), S.tile_ends("top", ORDERS[1], 10, first=1)]
    got = {r["g"]: r for r in S.rows_at(base, ["g"], cuts).collect()}
    by_group = {}
    for r in base.collect():
        by_group.setdefault(r["g"], []).append(r)
    assert set(got) == set(by_group)
    for g, rs in by_group.items():
        xs, n = sorted(r["x"] for r in rs), len(rs)
        assert got[g]["mid_n"] == n
        assert (got[g]["mid_0"]["k0"], got[g]["mid_1"]["k0"]) == (xs[(n - 1) // 2], xs[n // 2])
        best = sorted(rs, key=lambda r: (-r["x"], r["name"], -r["id"]))[-(-n // 10) - 1]
        assert tuple(got[g]["top_0"]) == (best["x"], best["name"], best["id"])


def test_few_rows_are_kept(rows, spark):
    """Of 200,000 different values one in a hundred reaches the histogram, in any order."""
    many = materialize(spark.range(200_000).selectExpr("id", "(id * 7919) % 200000 as x"), "many")
    cuts = S.tile_ends("t", [("x", "asc")], 3)
    hist = S._histogram(many, [], [cuts], S._intervals(many, [], [cuts], "t"))
    assert hist.where("_kept").count() < 2000 and hist.agg(F.sum("_count")).first()[0] == 200_000
    ends = S.rows_at(many, [], [cuts]).first()
    assert (ends["t_0"]["k0"], ends["t_1"]["k0"]) == (66_666, 133_333)


def test_a_sketch_that_misses_is_noticed(rows, monkeypatch):
    """Intervals that lie beside the positions: the round is repeated with all entries."""
    order = ORDERS[0]
    want = S.rows_at(rows, ["g"], [S.tile_ends("t", order, 4)]).orderBy("g").collect()
    monkeypatch.setattr(S, "MARGIN", -0.05)
    got = S.rows_at(rows, ["g"], [S.tile_ends("t", order, 4)]).orderBy("g").collect()
    assert str(got) == str(want)


def test_empty_and_single_rows(rows):
    cuts = S.tile_ends("t", ORDERS[0], 4)
    assert S.with_cuts(rows.limit(0), ["g"], [cuts]).count() == 0
    assert S.with_cuts(rows.limit(0), [], [cuts]).count() == 0
    one = S.with_cuts(rows.where("id = 17"), ["g"], [cuts]).withColumn("tile", S.tile_of(cuts, 4))
    assert [r["tile"] for r in one.collect()] == [1]


@pytest.mark.parametrize("group", [["g"], []])
def test_many_ranks_in_one_sort(rows, group):
    specs = [([("x", "desc")], "a", "rank"), ([("big", "asc"), ("name", "desc")], "b", "dense_rank"),
             ([("x", "asc")], "c", "dense_rank"), ([("name", "asc")], "d", "rank")]
    got = ranks_within(rows, group, specs, store=False, total="n")
    base = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    want = rows.withColumn("n", F.count(F.lit(1)).over(base))
    for order, out, method in specs:
        fn = F.rank() if method == "rank" else F.dense_rank()
        want = want.withColumn(out, fn.over(base.orderBy(*order_exprs(order))))
    cols = ["id", "a", "b", "c", "d", "n"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(
        map(tuple, want.select(cols).collect()))
