"""CSV round trips, catalog DDL and the streaming batch ingest."""

import tempfile

import pytest
from pyspark.sql import functions as F

from scorekit.plans.cleaning import clean_companies
from scorekit.sources import catalog, files
from scorekit.sources.bindings import companies, companies_raw
from scorekit.streaming.batch_ingest import ingest_batches, read_ingested, start_ingest

from .conftest import SF_SMALL


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_csv_append_and_read_back(spark):
    raw = companies_raw(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="csv-") + "/companies_csv"
    files.append_csv(raw.filter("batch = 1"), path)
    files.append_csv(raw.filter("batch = 2"), path)
    back = files.read_csv(spark, path)
    assert _rows(back) == _rows(raw)


def test_write_clean_refuses_in_place_overwrite(spark):
    path = tempfile.mkdtemp(prefix="clean-") + "/t"
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError):
        files.write_clean(spark.read.parquet(path), path)
    files.write_clean(spark.read.parquet(path), path + "_2")
    assert spark.read.parquet(path + "_2").count() == 3


def test_catalog_table_round_trip(spark):
    catalog.use_database(spark, "company_analysis_test")
    catalog.create_companies_table(spark, "companies", replace=True)
    src = companies(spark, SF_SMALL)
    catalog.load_companies(src, "companies")
    assert _rows(spark.table("companies")) == _rows(src)
    spark.catalog.setCurrentDatabase("default")


def test_streaming_ingest_equals_batch_cleaning(spark):
    raw = companies_raw(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="ingest-")
    landing, out, ckpt = base + "/landing", base + "/out", base + "/ckpt"
    for b in (1, 2):  # two crawl runs, in order
        raw.filter(F.col("batch") == b).coalesce(1).write.mode("append") \
           .option("header", True).csv(landing)
        for q in start_ingest(spark, landing, out, ckpt, once=True):
            q.awaitTermination(300)
    got = read_ingested(spark, out)
    expect = clean_companies(raw, keep_order_columns=True)
    assert _rows(got) == _rows(expect)


def test_a_batch_lands_in_many_files(spark):
    import glob

    from scorekit.session import scratch_dir
    raw = companies_raw(spark, SF_SMALL)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = _rows(ingest_batches(raw, "ingest-many"))
    finally:
        spark.conf.unset(key)
    assert got == _rows(clean_companies(raw, keep_order_columns=True))
    landed = glob.glob(scratch_dir(spark).removeprefix("file:") + "/ingest-many-*/landing")
    files_of = files.read_csv(spark, landed[0]).select("batch", F.input_file_name()).distinct()
    n = {r["batch"]: r["count"] for r in files_of.groupBy("batch").count().collect()}
    assert len(n) == 2 and min(n.values()) > 1


def test_release_intermediates(spark):
    import os

    from scorekit.session import materialize, release_intermediates, scratch_dir
    m = materialize(spark.range(5), "tmp-release")
    assert m.count() == 5
    root = scratch_dir(spark)
    local = root[len("file:"):] if root.startswith("file:") else root
    assert os.path.exists(local)
    release_intermediates(spark)
    assert not os.path.exists(local)


def test_entry_module_from_another_directory(tmp_path):
    """The driver may import __spark_entry__ by file path from any directory."""
    import subprocess
    import sys
    import os
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                         "__spark_entry__.py")
    code = ("import importlib.util; s = importlib.util.spec_from_file_location("
            f"'e', {entry!r}); m = importlib.util.module_from_spec(s); "
            "s.loader.exec_module(m); print(set(m.oracle_sql()) <= set(m.queries()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True,
                         text=True, timeout=120)
    assert out.stdout.strip().endswith("True"), out.stderr[-500:]


def test_cli_lists_every_query():
    import subprocess
    import sys

    import os

    from scorekit.plans.registry import all_queries
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-m", "scorekit", "list"], cwd=repo,
                         capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == list(all_queries())
