"""Target-distribution importance resampling: documents that look like a target text
are drawn with Gumbel noise, without replacement.

Words are found on bytes: one 256-byte table lower-cases A-Z and blanks every
separator (bytes from 0x80 on belong to words, so UTF-8 needs no decoding), and
``bytes.split`` yields them.  The crc32 of an n-gram continues that of its
(n-1)-gram, ``crc32(b" " + word, seed)``, so no n-gram is ever joined.  Each task
reduces its features to a ``Counter`` of buckets; only those (``buckets`` rows a
task at most) shuffle, and only their sums reach the driver, which turns the two
models into one integer gain a bucket.  A second pass over the texts sums the gains.
Both passes run where the texts lie: no text and no n-gram shuffles.

The draw sorts no more than it must.  A quantile sketch of the scores gives a cut a
little below the last drawn score, rows under the cut pass straight through, and the
rest (about the drawn share) is range-sorted and numbered by
``operators.positions``, so ranks need no task of their own.

Edge cases: null and empty texts have no feature and weight 0, and are never drawn as
they have fewer than ``min_words`` words; a null id counts as an empty string in the
noise and, as Spark sorts it, as the smallest id among ties; repeated rows are
ordinary rows: they share score and noise and get neighbouring ranks; ties in score
go to the smaller id; a very long text is read ``BLOCK`` bytes at a time, so a worker
holds the words of one block; empty documents give no rows; without target texts all
target counts are 0; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import row_positions
from ..session import materialize, ship_package

BUCKETS = 10_000
ORDER = 3
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
SEED = 42
#: How far below the last drawn score the sketch aims, as a share of the rows.
MARGIN = 0.002
SKETCH = 10_000


def _byte(b: int) -> int:
    if 0x41 <= b <= 0x5A:
        return b + 32
    return b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20


TABLE = bytes(map(_byte, range(256)))


def word_blocks(text: bytes | None, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists of about ``block`` bytes."""
    text = (text or b"").translate(TABLE)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + block)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(text: bytes | None, order: int = ORDER, buckets: int = BUCKETS,
             block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """``(words, buckets of the n-grams that end in them)`` for each block of a text."""
    before: list[bytes] = []  # the last words of the block before
    for words in word_blocks(text, block):
        if not words:
            continue
        known = len(before)
        words = before + words
        tails = [b" " + w for w in words]
        grams = list(map(crc32, words))
        found = grams[known:]
        for n in range(1, order):
            grams = list(map(crc32, tails[n:], grams))
            found += grams[max(known - n, 0):]
        yield len(words) - known, np.array(found, np.uint32) % np.uint32(buckets)
        before = words[-(order - 1):] if order > 1 else []


def noise(doc_id, seed: int = SEED) -> int:
    """Floor of 1000 times a standard Gumbel draw, told by the id alone."""
    name = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(name).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def bucket_counts(texts: DataFrame, text_col: str, order: int = ORDER,
                  buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows and whole texts."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for b in batches:
            for t in b.column(0):
                for _, found in features(t.as_py(), order, buckets):
                    total.update(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array(list(total.values()), pa.int64())],
                                         schema=schema)

    ship_package(texts.sparkSession)
    summed = (texts.select(F.col(text_col).cast("binary").alias("text"))
                   .mapInArrow(run, "bucket int, n long")
                   .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(target share / raw share))`` a bucket, both with one added."""
    s_all, t_all = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all)))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          order: int = ORDER, seed: int = SEED) -> DataFrame:
    """``doc_id, row, n_words, n_features, weight, score`` per row, written once; ``row``
    tells rows of one id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            sums = np.zeros((3, b.num_rows), np.int64)
            for i, t in enumerate(b.column(1)):
                for words, found in features(t.as_py(), order, len(gain)):
                    sums[:, i] += words, len(found), gain[found].sum()
            draw = np.fromiter((noise(i, seed) for i in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(s) for s in sums), pa.array(sums[2] + draw)],
                names=["doc_id", "n_words", "n_features", "weight", "score"])

    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"),
                        F.col(text_col).cast("binary").alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, "
                                   "weight long, score long")
    return materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scores")


def draw_top(scored: DataFrame, eligible, share_percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the ``floor(share_percent * N / 100)``
    largest scores of the ``N`` rows that are ``eligible``, ties to the smaller id."""
    spots = F.coalesce(eligible, F.lit(False))
    n, lowest = scored.where(spots).agg(F.count(F.lit(1)), F.min("score")).first()
    k = share_percent * n // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    below = max(0.0, 1 - k / n - MARGIN)
    cut = scored.where(spots).agg(F.percentile_approx("score", below, SKETCH)).first()[0]
    near = spots & (F.col("score") >= cut)
    if scored.where(near).count() < k:  # beyond the sketch's error: take every row
        cut = lowest
        near = spots & (F.col("score") >= cut)
    order = [("score", "desc"), ("doc_id", "asc"), ("row", "asc")]
    ranked = row_positions(scored.where(near), [], order, "rank", "_n", "draw").drop("_n")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")).cast("long"))
    rest = scored.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).unionByName(rest)


def target_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", target_text_col: str = "text", order: int = ORDER,
                    buckets: int = BUCKETS, share_percent: int = 5, min_words: int = 20,
                    seed: int = SEED) -> DataFrame:
    """Every document with ``n_words, n_features, weight, score`` and, if it is drawn, its
    ``rank``."""
    gain = gains(bucket_counts(docs, text_col, order, buckets),
                 bucket_counts(target, target_text_col, order, buckets))
    scored = score(docs, gain, id_col, text_col, order, seed)
    return draw_top(scored, F.col("n_words") >= min_words, share_percent).drop("row")
