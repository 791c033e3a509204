"""Removal of repeated passages: Rabin-Karp hashes of every ``window``-word window,
counted in Spark; repeated windows merge into maximal removal intervals.

Shuffling a hash for every word of the corpus would move more bytes than the
texts have, so windows are first thinned without losing a repetition:

1. Every window has an *anchor*, the ``gram``-word sequence inside it whose hash is
   least.  Equal windows have equal anchors, and about two words in
   ``window - gram + 2`` begin one.  Anchors are written per document and counted.
2. Only windows whose anchor occurs at two places or more can be repeated.  Their
   Rabin-Karp hashes are counted in Spark, each with its place.  A hash counted
   once gives the place of a window that is *not* repeated, so no place has to be
   looked up again; all other candidate windows are repeated.
3. Each document's repeated windows merge into intervals, which are removed.

All counts run over all documents and combine map-side, so a passage in a third of
all documents is a few rows a task.  A bitmap of the documents that have a repeated
anchor keeps all other texts in place.  Joins are shuffle joins on document keys or
hashes; a heavy hash is split by adaptive execution.

Edge cases: null texts and texts shorter than a window lose nothing (null: no
words); a window repeated inside its own document counts; repeated rows repeat all
their windows; null ids are ordinary; a very long text has one window a word, all of them
judged; there is nothing to tie; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import bitmap_bits, bitmap_of, slot_of, with_bit

WINDOW = 35
GRAM = 16
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(
            np.full(size, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


class WordHashes:
    """Prefix sums of a text's word hashes times powers of the base: any window's
    polynomial hash is a difference of two, shifted back to power zero."""

    def __init__(self, words: list[bytes]):
        import xxhash
        self.n = len(words)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, self.n)
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * up[:self.n], out=self.sums[1:])

    def rolling(self, k: int) -> np.ndarray:
        """The hash of the ``k`` words from each position."""
        m = self.n - k + 1
        h = (self.sums[k:] - self.sums[:m]) * self.down[:m]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window the position of its least gram (the first of equals), and
        the grams' hashes."""
        g = self.rolling(gram)
        m, span = self.n - window + 1, window - gram + 1
        low, at = g[:m].copy(), np.arange(m, dtype=np.int32)
        for j in range(1, span):
            c = g[j:j + m]
            less = c < low
            low[less] = c[less]
            at[less] = np.flatnonzero(less) + j
        return at, g


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _anchor_table(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int):
    schema = pa.schema([("key", pa.int64()), ("hashes", pa.list_(pa.int64())),
                        ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                keys, hashes, places = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = text.split()
                    if len(words) >= window:
                        pos, g = WordHashes(words).anchors(window, gram)
                        pos = np.unique(pos)
                        keys.append(key)
                        hashes.append(g[pos].view(np.int64))
                        places.append(pos)
                ends = np.cumsum([0, *map(len, places)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()),
                     pa.ListArray.from_arrays(ends, np.concatenate(hashes or [np.empty(0, np.int64)])),
                     pa.ListArray.from_arrays(ends, np.concatenate(places or [np.empty(0, np.int32)])
                                              .astype(np.int32))], schema=schema)

    d = docs.where(F.col(text_col).isNotNull()).select(
        _key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return materialize(d.mapInArrow(run, "key long, hashes array<long>, places array<int>"),
                       "anchors")


def _candidates(words: list[bytes], places, window: int, gram: int) -> tuple:
    """Positions of the windows whose anchor is one of ``places``."""
    h = WordHashes(words)
    pos, _ = h.anchors(window, gram)
    hot = np.zeros(h.n, bool)
    hot[np.asarray(places, np.int64)] = True
    return h, np.flatnonzero(hot[pos])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` and
    ``intervals``, the maximal ranges ``(start, end)`` of removed words; with
    ``keep_text`` also ``kept_text``, the kept words joined by one space."""
    spark = docs.sparkSession
    ship_package(spark)
    table = _anchor_table(docs, id_col, text_col, window, gram)
    # 1. anchors at two places or more, and the documents that have them
    repeated = materialize(table.select(F.explode("hashes").alias("hash")).groupBy("hash").count()
                                .where("count > 1").select("hash"), "repeated-anchors")
    n_bits = bitmap_bits(repeated.count())
    bitmap = materialize(bitmap_of(repeated.select(slot_of(F.col("hash"), 1, n_bits)
                                                   .alias("slot"))), "anchor-slots")
    spots = table.select("key", F.explode(F.arrays_zip("hashes", "places")).alias("a"))
    spots = spots.select("key", F.col("a.hashes").alias("hash"), F.col("a.places").alias("place"))
    spots = with_bit(spots, slot_of(F.col("hash"), 1, n_bits), bitmap, "hit").where("hit")
    spots = materialize(spots.drop("hit").join(repeated, "hash", "left_semi").groupBy("key")
                             .agg(F.collect_set("place").alias("places")), "spots")
    key_bits = bitmap_bits(spots.count())
    key_map = materialize(bitmap_of(spots.select(slot_of(F.col("key"), 2, key_bits)
                                                 .alias("slot"))), "key-slots")
    d = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, text_col).alias("key"),
                    F.col(text_col).cast("binary").alias("text"))
    d = with_bit(d, slot_of(F.col("key"), 2, key_bits), key_map, "hit")
    tested = materialize(d.where("hit").drop("hit").join(spots, "key", "left"), "tested")

    # 2. the candidate windows, counted; those counted once, by document
    schema = pa.schema([("hash", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())])

    def windows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                hashes, keys, poss = [], [], []
                for key, text, places in zip(*(part.column(i).to_pylist() for i in range(3))):
                    h, pos = _candidates(text.split(), places, window, gram)
                    hashes.append(h.rolling(window)[pos])
                    keys.append(np.full(len(pos), key, np.int64))
                    poss.append(pos.astype(np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.concatenate(hashes)), pa.array(np.concatenate(keys)),
                         pa.array(np.concatenate(poss))], schema=schema)

    counted = (tested.where("places is not null").select("key", "text", "places")
                     .mapInArrow(windows, "hash long, key long, pos int")
                     .groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"),
                                          F.min("pos").alias("pos")))
    once = materialize(counted.where("n = 1").groupBy("key")
                              .agg(F.collect_list("pos").alias("once")), "once")

    # 3. merge the repeated windows and remove them
    id_type = d.schema["doc_id"].dataType.simpleString()
    out_type = (f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, "
                "intervals array<struct<start:long,end:long>>"
                + (", kept_text string" if keep_text else ""))

    def remove(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                rows = []
                for text, places, single in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    words = (text or b"").split()
                    kept, spans = words, []
                    if places:
                        _, pos = _candidates(words, places, window, gram)
                        edge = np.zeros(len(words) + 1, np.int64)
                        pos = np.setdiff1d(pos, np.asarray(single or [], np.int64),
                                           assume_unique=True)
                        edge[pos] += 1
                        edge[pos + window] -= 1
                        gone = np.cumsum(edge[:-1]) > 0
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                        spans = [{"start": int(s), "end": int(e)}
                                 for s, e in zip(turn[::2], turn[1::2])]
                        kept = [words[i] for i in np.flatnonzero(~gone)]
                    body = b" ".join(kept)
                    rows.append((len(words), len(words) - len(kept),
                                 hashlib.sha256(body).hexdigest(), spans,
                                 body.decode() if keep_text else None))
                cols = list(zip(*rows)) or [()] * 5
                span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                arrays = [part.column(0), pa.array(cols[0], pa.int64()),
                          pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                          pa.array(cols[3], span_type)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals"]
                if keep_text:
                    arrays.append(pa.array(cols[4], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    cols = ["doc_id", "text", "places", "once"]
    places, single = (F.lit(None).cast("array<int>").alias(c) for c in ("places", "once"))
    straight = d.where("not hit").select("doc_id", "text", places, single)
    joined = tested.join(once, "key", "left").select(*cols)
    return straight.mapInArrow(remove, out_type).unionByName(joined.mapInArrow(remove, out_type))
