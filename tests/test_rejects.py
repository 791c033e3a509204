"""Tolerant loading, in batch and as a stream; table functions over pages."""

import tempfile

import pytest
from pyspark.sql import functions as F

from scorekit.plans import extraction as X
from scorekit.plans.cleaning import clean_companies
from scorekit.schema import COMPANIES_RAW
from scorekit.sources import card_pages, files, page_tables
from scorekit.sources import rejects as R
from scorekit.sources.bindings import companies_raw
from scorekit.sources.tables import read_table
from scorekit.streaming.batch_ingest import (
    compact_ingested,
    ingested_table,
    read_ingested,
    read_rejects,
    start_ingest,
)

from .conftest import SF_SMALL

LINES = """batch,pos,Name,Rating,Rating Count,Headquarters,Company_year,Employees Count
1,1,Acme,4.1,3.1k,"Pune, India",1999,501-1k
1,2,Short,4.0
x,3,Letters,4.0,10,Here,2000,10
1,4,Extra,4.0,10,Here,2000,10,more
1,5,Count,4.0,lots,Here,2000,10
1,6,Stars,good,10,Here,2000,10
1,7,{long},4.0,10,Here,2000,10
1,8,,,,,,
"1,9,Quote,4.0,10,Here,2000,10
1,10,Both,good,lots,{long},2000,10
""".format(long="n" * 256)


@pytest.fixture
def folder(spark):
    path = tempfile.mkdtemp(prefix="lines-")
    with open(path + "/a.csv", "w") as f:
        f.write(LINES)
    return path


def test_every_line_is_accepted_or_rejected_with_a_reason(spark, folder):
    good, bad = R.load_csv(spark, folder)
    assert sorted(r["pos"] for r in good.collect()) == [1, 8]
    assert good.columns == COMPANIES_RAW.fieldNames()
    reasons = {r["pos"]: r[R.REASON] for r in bad.collect() if r["pos"]}
    assert reasons == {2: R.MALFORMED, 3: R.MALFORMED, 4: R.MALFORMED,
                       5: "Rating Count: not a number", 6: "Rating: not a number",
                       7: "Name: over 255 characters", 10: "Rating Count: not a number"}
    lines = {r[R.LINE] for r in bad.where(F.col(R.REASON) == R.MALFORMED).collect()}
    assert "1,2,Short,4.0" in lines and "1,4,Extra,4.0,10,Here,2000,10,more" in lines
    assert good.count() + bad.count() >= 9  # the open quote may take the line after it


def test_other_rules_and_tables(spark):
    df = spark.createDataFrame([(1, "a"), (-1, "b"), (None, None)], "x int, s string")
    good, bad = R.split(df, [("negative", F.col("x") < 0), ("no s", F.col("s").isNull())])
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    assert sorted((r[R.REASON], r["x"]) for r in bad.collect()) == [("negative", -1), ("no s", None)]
    good, bad = R.split(df.limit(0), R.too_long({"s": 1}))
    assert good.count() == bad.count() == 0


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_bad_line_costs_a_line_of_the_stream(spark):
    raw = companies_raw(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="stream-")
    landing, out = base + "/landing", base + "/out"
    raw.where("batch = 1").coalesce(1).write.option("header", True).csv(landing)
    with open(landing + "/bad.csv", "w") as f:
        f.write("batch,pos,Name\n1,2\n9,9,not,enough\n")

    def ingest():
        for q in start_ingest(spark, landing, out, base + "/checkpoint", once=True):
            q.awaitTermination(300)

    ingest()
    bad = read_rejects(spark, out)
    assert {r[R.LINE] for r in bad.collect()} == {"1,2", "9,9,not,enough"}
    raw.where("batch = 2").coalesce(1).write.mode("append").option("header", True).csv(landing)
    ingest()
    want = rows_of(clean_companies(raw, keep_order_columns=True))
    assert rows_of(read_ingested(spark, out)) == want
    assert compact_ingested(spark, out, rows_per_bucket=40) == ingested_table(spark, out).buckets > 1
    assert rows_of(read_ingested(spark, out)) == want


def test_a_replayed_epoch_changes_nothing(spark):
    from scorekit.streaming.batch_ingest import _ingest
    raw = companies_raw(spark, SF_SMALL).withColumn(R.LINE, F.lit(None).cast("string"))
    out = tempfile.mkdtemp(prefix="replay-")
    run = _ingest(out, 8, ())
    for epoch, batch in ((0, 1), (1, 2), (1, 2)):
        run(raw.where(F.col("batch") == batch), epoch)
    assert rows_of(read_ingested(spark, out)) == rows_of(
        clean_companies(raw.drop(R.LINE), keep_order_columns=True))


def test_cards_by_sql_equal_the_extraction_job(spark):
    pages = card_pages.listing_pages(spark, SF_SMALL)
    assert rows_of(page_tables.cards_by_sql(spark, pages)) == rows_of(X.extract_cards(pages))


@pytest.mark.parametrize("selector, want", [
    ("h2", ["A", "B"]), (".x", ["A", "p"]), ("h2.x", ["A"]), ("h3", []), ("", []), (None, [])])
def test_elements_by_sql(spark, selector, want):
    html = '<h2 class="x y">A</h2><p class="x">p</p><h2>B</h2>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = page_tables.elements_by_sql(spark, pages, selector).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["pos"], r["text"]) for r in got] == [
        (1, i, t) for i, t in enumerate(want)]


def test_table_functions_from_plain_sql(spark):
    page_tables.register(spark)
    read_table(spark, SF_SMALL, "pages").createOrReplaceTempView("stored_pages")
    got = spark.sql("SELECT p.page_id, count(*) AS n FROM stored_pages p, "
                    "LATERAL page_elements(p.html, 'a') e GROUP BY p.page_id")
    assert got.agg(F.sum("n")).first()[0] > 0
