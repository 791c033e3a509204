"""A keyed table that takes overlapping crawl batches without being recomputed.

Rows are unique by key and the first row of a key (in ``order``) wins, whatever the
order in which batches arrive.  The table is hash-bucketed: ``_bucket`` is a partition
column of its Parquet folder, so a batch reads only the buckets its keys fall into, and
of those only keys and order; it rewrites only buckets in which one of its rows wins, by
dynamic partition overwrite.  A batch of rows that the table holds already rewrites
nothing.  Merging the same batch again, or one that a failed job left half merged,
gives the same table.

The number of buckets should grow with the table.  :meth:`BucketedTable.compact` deals the
rows over as many as the wanted rows a bucket call for, one file each, into a new
generation folder; readers take the newest generation that was written to its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize

BUCKET = "_bucket"


@dataclass(frozen=True)
class Merged:
    """What a merge did: rows that entered the table (new keys, or earlier rows of known
    ones), buckets that the batch's keys fall into, and buckets that were rewritten."""

    entered: int
    touched: int
    rewritten: int


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by partial aggregation; NULL keys are equal."""
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first"))
              .select("_first.*"))


class BucketedTable:
    """``keys`` tell rows apart, ``order`` (unique among rows of one key) says which comes
    first.  ``buckets`` is the number of buckets of a new table."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str],
                 order: Sequence[str], buckets: int = 256):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.order, self.first_buckets = list(keys), list(order), buckets

    # ------------------------------------------------------------ generations

    def _folder(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _generations(self) -> list[tuple[int, int]]:
        """``(number, buckets)`` of the generations that were written to their end."""
        p, fs = self._folder(self.path)
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            done, _ = self._folder(f"{self.path}/{name}/_SUCCESS")
            if name.startswith("generation-") and fs.exists(done):
                number, buckets = name.removeprefix("generation-").split("-")
                found.append((int(number), int(buckets)))
        return sorted(found)

    def _place(self, number: int, buckets: int) -> str:
        return f"{self.path}/generation-{number}-{buckets}"

    @property
    def buckets(self) -> int:
        generations = self._generations()
        return generations[-1][1] if generations else self.first_buckets

    def _bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _stored(self) -> DataFrame | None:
        generations = self._generations()
        return self.spark.read.parquet(self._place(*generations[-1])) if generations else None

    def read(self) -> DataFrame:
        """The table's rows."""
        stored = self._stored()
        if stored is None:
            raise ValueError(f"no table at {self.path}")
        return stored.drop(BUCKET)

    # ------------------------------------------------------------------ writes

    def _write(self, rows: DataFrame, place: str, n_buckets: int, mode: str = "static") -> None:
        """Bucket by bucket; a ``static`` write ends with the generation's ``_SUCCESS``."""
        (rows.repartition(max(1, n_buckets), BUCKET)
             .write.mode("overwrite").option("partitionOverwriteMode", mode)
             .partitionBy(BUCKET).parquet(place))

    def merge(self, batch: DataFrame) -> Merged:
        """Add the rows of ``batch`` whose key is new, or that come before the table's row
        of their key."""
        buckets, stored = self.buckets, self._stored()
        first = materialize(keep_first(batch, self.keys, self.order)
                            .withColumn(BUCKET, self._bucket_of(buckets)), "merge-batch")
        touched = self._ids(first)
        if not touched:  # an empty batch; it starts no table
            discard(first)
            return Merged(0, 0, 0)
        if stored is None:
            self._write(first, self._place(1, buckets), buckets)
            done = Merged(first.count(), len(touched), len(touched))
            discard(first)
            return done
        names = {k: f"_old{i}" for i, k in enumerate([*self.keys, *self.order])}
        # literal buckets: the scan lists and reads only their folders
        old = stored.where(F.col(BUCKET).isin(touched)).select(
            *[F.col(k).alias(a) for k, a in names.items()], F.lit(True).alias("_known"))
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(names[k]))
        earlier = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(self.order)]) < (
            F.struct(*[F.col(names[o]).alias(f"o{i}") for i, o in enumerate(self.order)]))
        winners = materialize(first.join(old, same, "left")
                              .where(F.col("_known").isNull() | earlier)
                              .select(first.columns), "merge-winners")
        changed = self._ids(winners)
        if not changed:
            discard(first, winners)
            return Merged(0, len(touched), 0)
        rows = stored.where(F.col(BUCKET).isin(changed)).unionByName(winners)
        # written aside first: the buckets are then replaced from rows that stay readable
        merged = materialize(keep_first(rows, self.keys, self.order), "merge-rows")
        self._write(merged, self._place(*self._generations()[-1]), len(changed), "dynamic")
        done = Merged(winners.count(), len(touched), len(changed))
        discard(first, winners, merged)
        return done

    @staticmethod
    def _ids(rows: DataFrame) -> list[int]:
        """Bucket numbers of ``rows``: as many as buckets at most."""
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def compact(self, rows_per_bucket: int = 1_000_000) -> int:
        """Deal the table over as many buckets (a power of two) as ``rows_per_bucket`` call
        for, one file each; returns their number.  Older generations are deleted after
        the new one has been written to its end."""
        rows, generations = self.read(), self._generations()
        buckets = 1
        while buckets * rows_per_bucket < rows.count():
            buckets *= 2
        number = generations[-1][0] + 1
        self._write(rows.withColumn(BUCKET, self._bucket_of(buckets)),
                    self._place(number, buckets), buckets)
        for g in generations:
            p, fs = self._folder(self._place(*g))
            fs.delete(p, True)
        return buckets


def scratch_table(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str],
                  buckets: int = 256) -> BucketedTable:
    """A new table under ``root``."""
    return BucketedTable(spark, f"{root}/merged-{uuid.uuid4().hex}", keys, order, buckets)
