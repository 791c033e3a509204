"""Quality classifier by importance resampling: the ratio of two hashed n-gram models,
of target text and of raw text, sampled with Gumbel top-k.

Each text becomes counts of n-grams hashed to ``BUCKETS`` buckets: its words, and
pairs and triples of word *shapes*.  A shape keeps what a word looks like (letter
case, digits, other characters, runs collapsed) and how recently the same word came
before.  The target model counts up to ``MAX_TARGET`` labelled texts of good quality, the
raw model every text of the corpus; both are smoothed.  A document's importance is the sum of
log(target / raw) over its n-grams.  Adding Gumbel noise, drawn from a hash of the
document, and keeping the ``k`` largest keys samples ``k`` documents without
replacement in proportion to their importance.

``k`` is the share of good labels, with three standard errors added so that chance
in the labels costs no good document, times the number of documents.  The k-th largest
key is found by counting keys in ever finer ranges, ``RANGES`` counts a round; keys
never sort in one task.  Rows with the very key of the k-th all stay.

Bounds: a model is ``BUCKETS`` counts; each task adds up its own before the shuffle,
and only the summed counts reach the driver.  The raw counts, the scores and the choice
of the k-th key cover all rows and whole texts.

Edge cases: null and empty texts have no n-gram and importance 0; null ids and
repeated rows are ordinary rows, and rows equal in id and text share key and fate;
ties with the last key kept are kept; a very long text is turned into n-grams whole, by
one worker; without a label of good quality, or without a bad one, every document is kept;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import content_key, remove_losers

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Labelled texts of good quality that the target model counts, chosen by a hash of the id.
MAX_TARGET = 20_000
#: Words whose shape a worker remembers.
CACHE_WORDS = 200_000
RANGES = 4096
_SHAPES = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"),
           (re.compile(rb"[0-9]+"), b"9"), (re.compile(rb"([^a-zA-Z0-9])\1+"), rb"\1\1")]
#: How far back a word last came: never, 1, 2 to 3, 4 to 7, ... and 128 or more.
_RECENT = 1 << np.arange(8)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Shapes(dict):
    """``word -> hash of its shape``, computed on a miss."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= CACHE_WORDS:
            self.clear()
        shape = word
        for pattern, by in _SHAPES:
            shape = pattern.sub(by, shape)
        self[word] = out = xxhash.xxh3_64_intdigest(shape)
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return h ^ (h >> np.uint64(29))


def ngrams(text: bytes | None, shapes: Shapes) -> np.ndarray:
    """Buckets of all n-grams of a UTF-8 text."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    from xxhash import xxh3_64_intdigest
    word = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    shape = np.fromiter(map(shapes.__getitem__, words), np.uint64, n)
    order = np.argsort(word, kind="stable")
    same = word[order][1:] == word[order][:-1]
    back = np.zeros(n, np.int64)
    back[order[1:][same]] = np.diff(order)[same]
    recent = np.searchsorted(_RECENT, back, side="right").astype(np.uint64)
    s = _mix(shape + recent * np.uint64(0xD6E8FEB86659FD93))
    two = _mix(s[:-1] * np.uint64(3) + s[1:])
    three = _mix(two[:-1] * np.uint64(5) + s[2:])
    grams = np.concatenate([_mix(word), two, three]) if n > 1 else _mix(word)
    return (grams >> np.uint64(48)).astype(np.int64) % BUCKETS


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col))
                       .alias("key"), F.col(text_col).cast("binary").alias("text"))


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts by bucket over all rows of ``texts (text, good)``: shape (2, BUCKETS), the
    second over rows with ``good``."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, total = Shapes(), np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                grams = [ngrams(t, shapes) for t in part.column(0).to_pylist()]
                good = [g for g, y in zip(grams, part.column(1).to_pylist()) if y]
                for i, some in enumerate((grams, good)):
                    if some:
                        total[i] += np.bincount(np.concatenate(some), minlength=BUCKETS)
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)),
             pa.array(total[kind, bucket])], schema=schema)

    summed = (texts.select("text", "good").mapInArrow(run, "kind int, bucket int, n long")
                   .groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros((2, BUCKETS), np.int64)
    out[summed.column("kind").to_numpy(), summed.column("bucket").to_numpy()] = (
        summed.column("n").to_numpy())
    return out


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest ``gumbel`` (``1 <= k <= rows``).  Each round counts the keys of
    one range in finer ranges."""
    low, high = keys.agg(F.min("gumbel"), F.max("gumbel")).first()
    while low < high:
        width = (high - low) / RANGES
        if not width:  # neighbouring numbers: the upper is the rest of the range
            above = keys.where(F.col("gumbel") == high).count()
            return high if k <= above else low
        at = F.least(F.floor((F.col("gumbel") - low) / width), F.lit(RANGES - 1))
        bins = (keys.where(F.col("gumbel").between(low, high))
                    .groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"),
                                                  F.min("gumbel").alias("low"),
                                                  F.max("gumbel").alias("high"))
                    .orderBy(F.desc("bin")).collect())  # RANGES rows at most
        for b in bins:
            if k <= b["n"]:
                break
            k -= b["n"]
        low, high = b["low"], b["high"]
    return low


def importance_keys(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality",
                    smoothing: float = SMOOTHING,
                    max_target: int = MAX_TARGET) -> tuple[DataFrame, float]:
    """``(doc_id, key, n_grams, importance, gumbel)`` per row, written once, and the
    share of documents to keep."""
    ship_package(docs.sparkSession)
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
              .where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y")))
    n, good = marked.agg(F.count(F.lit(1)), F.sum("y")).first()
    texts = _texts(docs, id_col, text_col)
    share = good / n if n else 1.0
    if share in (0.0, 1.0):
        ratio = np.zeros(BUCKETS)
        share = 1.0
    else:
        # at most max_target ids, so they are broadcast; no text moves
        chosen = marked.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(max_target)
        chosen = chosen.select("id", F.lit(True).alias("good"))
        raw, target = gram_counts(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"),
                                             "left"))
        ratio = (np.log(target + smoothing) - np.log(target.sum() + smoothing * BUCKETS)
                 - np.log(raw + smoothing) + np.log(raw.sum() + smoothing * BUCKETS))
        share = min(1.0, share + 3 * (share * (1 - share) / n) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                grams = [ngrams(t, shapes) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(g) for g in grams], pa.int64()),
                     pa.array([float(ratio[g].sum()) for g in grams], pa.float64())],
                    names=["doc_id", "key", "n_grams", "importance"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    d = texts.mapInArrow(run, f"doc_id {id_type}, key long, n_grams long, importance double")
    # uniform in (0, 1) from 53 bits of a second hash of the row's key
    u = (F.shiftrightunsigned(F.xxhash64("key", F.lit(77)), 11).cast("double") + 0.5) / float(1 << 53)
    return materialize(d.withColumn("gumbel", F.col("importance") - F.log(-F.log(u))),
                       "importance"), share


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """One row per document: ``doc_id, key, n_grams, importance, gumbel, kept``."""
    keys, share = importance_keys(docs, labels, id_col, text_col, label_col)
    n = keys.count()
    k = int(np.ceil(share * n))
    if k >= n:
        return keys.withColumn("kept", F.lit(True))
    return keys.withColumn("kept", F.col("gumbel") >= kth_largest(keys, k))


def keep_resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all columns."""
    gone = (resample(docs, labels, id_col, text_col, label_col).where("not kept")
            .select(content_key("doc_id", F.col("key").cast("string")).alias("key"),
                    F.lit(0).alias("keeps")).distinct())
    own = content_key(id_col, F.xxhash64(F.col(id_col), F.col(text_col)).cast("string"))
    return remove_losers(docs, own, gone)
