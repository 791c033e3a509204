"""Exact de-duplication with two-pass Bloom filtering (DataFrame functions only).

Pass one hashes every whole text once and writes ``(id, row, digest)`` to the
shared folder: about 50 bytes a document, and the only read of the texts.  Two
probes a digest are counted per filter slot; slots met at least twice form a
bitmap (at most 32 MB).  Pass two tests every digest: both slots met twice
means *possibly repeated*.  Only those digests shuffle, for the exact grouping;
all others pass straight through as groups of one.

Above the bitmap's bound more digests count as possibly repeated; the result
stays exact.  A hot group is counted map-side, and joining its one summary row
back is an ordinary shuffle join, whose large side adaptive execution splits.

Edge cases: a null text is the empty text; null ids sort last, so such a row
stays only if every row of its group has a null id; fully repeated rows (same
id, same text) are told apart by their row number, and one of them stays; that number
also decides ties of equal ids; of a very long text only the digest moves; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import (WS, bitmap_bits, bitmap_of, content_key, remove_losers, slot_of,
                     text_of, with_bit)


def normalised(text):
    """Null as empty; every run of white space as one space."""
    return F.regexp_replace(text_of(text), WS, " ")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, row, sha)`` per row, written once; ``row`` is unique."""
    return materialize(
        docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                    F.unhex(F.sha2(normalised(text_col), 256)).alias("sha")), "digests")


def possibly_repeated(keys: DataFrame, key: str, n_rows: int | None = None) -> DataFrame:
    """Add boolean ``maybe``: false only for keys that certainly occur once."""
    n_bits = bitmap_bits(keys.count() if n_rows is None else n_rows)
    probes = [slot_of(F.col(key), seed, n_bits) for seed in (11, 23)]
    twice = (keys.select(F.explode(F.array(*probes)).alias("slot"))
                 .groupBy("slot").count().where("count > 1"))
    bitmap = materialize(bitmap_of(twice), "repeated-slots")
    out = with_bit(with_bit(keys, probes[0], bitmap, "_hit0"), probes[1], bitmap, "_hit1")
    return out.withColumn("maybe", F.col("_hit0") & F.col("_hit1")).drop("_hit0", "_hit1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, row, sha, keep_id, keep_row, group_size``."""
    flagged = possibly_repeated(digests(docs, id_col, text_col), "sha")
    maybe = flagged.where("maybe").drop("maybe")
    groups = materialize(
        maybe.groupBy("sha").agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"),
            F.count(F.lit(1)).alias("group_size")), "groups")
    exact = maybe.join(groups, "sha").select(
        "id", "row", "sha", F.col("first.id").alias("keep_id"),
        F.col("first.row").alias("keep_row"), "group_size")
    alone = flagged.where("not maybe").select(
        "id", "row", "sha", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"),
        F.lit(1).cast("long").alias("group_size"))
    return alone.unionByName(exact)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts do not shuffle unless their key may be one that loses rows.  Of fully
    repeated rows one stays."""
    groups = exact_groups(docs, id_col, text_col).where("group_size > 1")
    sha = F.sha2(normalised(text_col), 256)
    losing = (groups.groupBy(content_key("id", F.lower(F.hex("sha"))).alias("key"))
              .agg(F.max((F.col("row") == F.col("keep_row")).cast("int")).alias("keeps"),
                   F.count(F.lit(1)).alias("n"))
              .where("keeps < n"))
    return remove_losers(docs, content_key(id_col, sha), losing)
