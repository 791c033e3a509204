"""Incremental merge of overlapping batches into a bucketed table."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scorekit.session import scratch_dir
from scorekit.sources.merge_table import Merged, scratch_table

SCHEMA = "name string, place string, batch int, pos long, value string"


def rows_of(batch, keys, rng=None):
    out = [(None if k % 50 == 3 else f"n{k}", None if k % 50 == 4 else f"p{k % 7}", batch, i, f"b{batch}k{k}")
           for i, k in enumerate(keys)]
    if rng:
        rng.shuffle(out)
    return out


def plain(batches):
    first = {}
    for r in sorted((r for b in batches for r in b), key=lambda r: (r[2], r[3])):
        first.setdefault((r[0], r[1]), r)
    return sorted(map(str, first.values()))


@pytest.fixture
def table(spark):
    return scratch_table(spark, scratch_dir(spark), ["name", "place"], ["batch", "pos"], 64)


def content(table):
    return sorted(str(tuple(r)) for r in table.read().select(SCHEMA.replace(",", "").split()[::2])
                  .collect())


def test_batches_in_any_order_give_the_first_rows(spark, table):
    rng = random.Random(1)
    batches = [rows_of(b, [rng.randrange(400) for _ in range(300)], rng) for b in (3, 1, 2)]
    for b in batches:
        table.merge(spark.createDataFrame(b, SCHEMA))
    assert content(table) == plain(batches)


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(table.path.removeprefix("file:")) for f in fs
            if f.startswith("part-")}


def test_only_buckets_with_new_rows_are_rewritten(spark, table):
    base = rows_of(1, range(5000))
    table.merge(spark.createDataFrame(base, SCHEMA))
    before = files(table)
    # a hundredth of the keys: the ones of one bucket's worth of new keys, and known ones
    new = rows_of(2, [*range(100, 140), *range(5000, 5010)])
    done = table.merge(spark.createDataFrame(new, SCHEMA))
    assert done.entered == len(plain([base, new])) - len(plain([base]))
    assert 0 < done.rewritten <= done.entered <= 10 < done.touched <= 50
    after = files(table)
    assert len(before.keys() & after.keys()) == len(before) - done.rewritten
    assert all(before[f] == after[f] for f in before.keys() & after.keys())
    assert content(table) == plain([base, new])


def test_one_hundredth_of_the_keys_rewrites_one_hundredth_of_the_buckets(spark, table):
    """New keys of 1 in 100 buckets, among 100 buckets."""
    t = scratch_table(spark, scratch_dir(spark), ["name", "place"], ["batch", "pos"], 100)
    df = spark.createDataFrame(rows_of(1, [k for k in range(4000) if k % 50 not in (3, 4)]), SCHEMA)
    t.merge(df)
    one = df.withColumn("b", t._bucket_of(100)).where("b = 17").drop("b")
    share = one.count() / df.count()
    assert 0.005 < share < 0.02
    earlier = one.withColumn("batch", F.lit(0)).withColumn("value", F.lit("new"))
    assert t.merge(earlier) == Merged(one.count(), 1, 1)
    assert t.read().where("value = 'new'").count() == one.count()


def test_known_rows_rewrite_nothing(spark, table):
    df = spark.createDataFrame(rows_of(1, range(300)), SCHEMA)
    table.merge(df)
    before = files(table)
    assert table.merge(df).rewritten == 0
    later = df.withColumn("batch", F.lit(9))
    assert table.merge(later).entered == 0 and files(table) == before


def test_compaction_keeps_the_rows_and_one_file_a_bucket(spark, table):
    batches = [rows_of(b, range(b * 200, b * 200 + 300)) for b in range(4)]
    for b in batches:
        table.merge(spark.createDataFrame(b, SCHEMA))
    want = content(table)
    assert table.compact(rows_per_bucket=100) == 16 and table.buckets == 16
    assert content(table) == want and len(files(table)) == 16
    batches.append(rows_of(9, range(2000, 2100)))
    table.merge(spark.createDataFrame(batches[-1], SCHEMA))
    assert content(table) == plain(batches) and table.compact(10 ** 6) == 1


def test_an_unfinished_generation_is_not_read(spark, table):
    df = spark.createDataFrame(rows_of(1, range(50)), SCHEMA)
    table.merge(df)
    os.makedirs(table.path.removeprefix("file:") + "/generation-2-8")
    assert table.buckets == 64 and table.read().count() == len(plain([rows_of(1, range(50))]))


def test_empty_batches_and_missing_tables(spark, table):
    with pytest.raises(ValueError):
        table.read()
    df = spark.createDataFrame(rows_of(1, range(20)), SCHEMA)
    assert table.merge(df.limit(0)) == Merged(0, 0, 0)
    with pytest.raises(ValueError):
        table.read()
    table.merge(df)
    assert table.merge(df.limit(0)) == Merged(0, 0, 0)
    assert table.read().count() == 20
