"""Structured Streaming ingest of scraped batches into a de-duplicated table.

Crawl runs drop CSV batches (``batch``, ``pos`` + scraped columns) into a landing
folder.  One streaming query reads it; each micro-batch is parsed once and then

* lines that do not fit the layout, and rows that ``rules`` refuse, are set aside with a
  reason in ``<out>/rejects/epoch=n``: a bad line costs a line, not the stream;
* the histogram of the parsed employee counts (one row per distinct value) goes to
  ``<out>/employees/epoch=n``: the global median of employees depends on every row,
  also on rows that are dropped later;
* named and rated rows are merged into the bucketed table ``<out>/rows``
  (:class:`BucketedTable`), where the first row of each (Name, Headquarters) stays.

The table is the only state: no state store holds keys, a micro-batch costs its own size
and the buckets in which one of its rows wins, and :func:`compact_ingested` deals the
table over a fitting number of buckets.  ``epoch=n`` folders are overwritten and the merge
finds its rows already there when a micro-batch runs again, so a replay changes nothing.

:func:`read_ingested` fills missing employees with the exact median of the merged
histogram; the result equals the batch cleaning job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.cleaning import CLEAN_COLUMNS, impute_constants, parse_fields
from ..session import discard, materialize
from ..sources import rejects as R
from ..sources.merge_table import BucketedTable

KEYS = ("Name", "Headquarters")
ORDER = ("batch", "pos")

COLUMNS = [*ORDER, *CLEAN_COLUMNS]


def ingested_table(spark: SparkSession, out: str, buckets: int = 16) -> BucketedTable:
    return BucketedTable(spark, f"{out}/rows", KEYS, ORDER, buckets)


def _cleaned(parsed: DataFrame) -> DataFrame:
    df = impute_constants(parsed).withColumn("Rating", F.col("Rating").try_cast("double"))
    return df.dropna(subset=["Name", "Rating"]).select(*COLUMNS)


def _ingest(out: str, buckets: int, rules: Sequence[R.Rule]):
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        tested = R.with_reason(batch, rules).withColumn("_text", F.struct(*batch.columns))
        rows = materialize(parse_fields(tested, on_error="null"), "ingest-batch")
        refused = rows.where(F.col(R.REASON).isNotNull()).select("_text.*", R.REASON)
        refused.write.mode("overwrite").parquet(f"{out}/rejects/epoch={epoch}")
        good = rows.where(F.col(R.REASON).isNull())
        (good.groupBy(F.col("Employees Count").alias("value")).count()
             .write.mode("overwrite").parquet(f"{out}/employees/epoch={epoch}"))
        ingested_table(spark, out, buckets).merge(_cleaned(good))
        discard(rows)
    return run


def start_ingest(spark: SparkSession, landing: str, out: str, checkpoint: str,
                 files_per_trigger: int = 1, once: bool = False, buckets: int = 16,
                 rules: Sequence[R.Rule] = ()) -> list[StreamingQuery]:
    """Start the ingest; returns its handle.  Without ``rules`` only malformed lines are
    refused, and a review count that cannot be parsed is NULL."""
    source = (spark.readStream.schema(R.with_line()).options(**R.csv_options())
                   .option("maxFilesPerTrigger", files_per_trigger).csv(landing))
    writer = (source.writeStream.foreachBatch(_ingest(out, buckets, rules))
                    .option("checkpointLocation", f"{checkpoint}/ingest"))
    return [(writer.trigger(availableNow=True) if once else writer).start()]


def read_rejects(spark: SparkSession, out: str) -> DataFrame:
    """Refused rows with their reason; of a malformed line its text and what could be read."""
    return spark.read.parquet(f"{out}/rejects").drop("epoch")


def compact_ingested(spark: SparkSession, out: str, rows_per_bucket: int = 1_000_000) -> int:
    """Deal the ingested rows over a fitting number of buckets (while no query writes)."""
    return ingested_table(spark, out).compact(rows_per_bucket)


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """The ingested rows with the global median of employees filled in."""
    from ..operators import median_table
    hist = (spark.read.parquet(f"{out}/employees").groupBy("value")
                 .agg(F.sum("count").alias("n")))
    median = median_table(hist, [], "value", "_median", weight="n",
                          label="ingest-median").scalar()
    rows = ingested_table(spark, out).read()
    return (rows.withColumn("Employees Count", F.coalesce(F.col("Employees Count"), median))
                .select(*COLUMNS))


def ingest_batches(raw: DataFrame, label: str = "ingest") -> DataFrame:
    """Land ``raw`` as CSV files in the order of ``batch`` and ``pos``, stream them in, a
    file for each core at a time, and return the ingested table (used by the registered
    streaming query)."""
    import uuid

    from ..session import scratch_dir
    spark = raw.sparkSession
    base = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    landing, out, ckpt = f"{base}/landing", f"{base}/out", f"{base}/checkpoint"
    # one pass: a crawl run spans many files; the merge makes their order irrelevant
    (raw.repartitionByRange(*ORDER).write.option("header", True).csv(landing))
    files = max(1, spark.sparkContext.defaultParallelism)
    for q in start_ingest(spark, landing, out, ckpt, files_per_trigger=files, once=True):
        q.awaitTermination()
    return read_ingested(spark, out)
