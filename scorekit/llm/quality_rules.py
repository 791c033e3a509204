"""Quality rules: base rules on whole texts, and gradient-boosted trees over document
statistics for everything the rules let through.

Statistics are computed once per whole text in an Arrow pass.  Trees are fitted on
the statistics of at most ``MAX_FIT`` labelled documents, chosen by a hash of their
id; only those rows of numbers reach the driver.  The fitted trees are flat arrays
of nodes and score a batch of documents level by level.  Where more of a statistic
can only be worse (symbols, repetition), the score may not rise with it.

A document is rejected if a base rule fails or the trees' probability of good quality
is under ``KEEP_AT``.

Edge cases: null and empty texts have no words and fail the base rules; null labels
and ids are not used in fitting; with fewer than ``LEAST_FIT`` labelled documents, or
one class alone, the base rules decide; repeated rows are judged alike, and a score at the
limit is kept; a very long text is measured whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .boosting import Trees, fit_trees
from .substring_dedup import WordHashes

MAX_FIT = 20_000
LEAST_FIT = 50
KEEP_AT = 0.5
REPEAT_WINDOW = 8
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics and the direction in which the score may move with them (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1,
    "repeat_share": -1, "upper_share": -1, "digit_share": 0, "punctuation_share": 0,
    "mark_share": -1, "distinct_share": 0, "top_word_share": -1, "same_word_share": -1,
    "line_words": 0, "lone_symbol_share": -1, "non_ascii_share": 0,
}
_WS = np.array([9, 10, 11, 12, 13, 32])
_PUNCT = np.frombuffer(b".,;:'\"()-", np.uint8)


def statistics(text: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts (``COUNTS``) and the features (``FEATURES``) of a UTF-8 text."""
    text = text or b""
    words = text.split()
    n = len(words)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(by.sum() - by[0x80:0xC0].sum())
    chars = points - int(by[_WS].sum())
    symbols = int(by[np.frombuffer(SYMBOLS, np.uint8)].sum())
    lines = [x for x in text.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    repeat = same = 0
    distinct = top = 0.0
    if n:
        h = WordHashes(words)
        one = h.rolling(1)
        _, counts = np.unique(one, return_counts=True)
        distinct, top = len(counts) / n, counts.max() / n
        same = int((one[1:] == one[:-1]).sum())
    if n > REPEAT_WINDOW:
        w = h.rolling(REPEAT_WINDOW)
        _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[inverse] > 1)
        edge = np.zeros(n + 1, np.int64)
        edge[at] += 1
        edge[at + REPEAT_WINDOW] -= 1
        repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    c, w, ln = max(chars, 1), max(n, 1), max(len(lines), 1)
    lone = sum(1 for x in words if len(x) == 1 and x in SYMBOLS)
    features = (np.log1p(n), chars / w, symbols / c, dup / ln, repeat / w,
                by[65:91].sum() / c, by[48:58].sum() / c, by[_PUNCT].sum() / c,
                by[33] / c, distinct, top, same / w, np.log1p(w / ln), lone / w,
                by[0xC0:].sum() / c)
    return (n, chars, symbols, dup, repeat), tuple(map(float, features))


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _measure(docs: DataFrame, id_col: str, text_col: str, trees: Trees | None,
             with_features: bool) -> DataFrame:
    ship_package(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS)
    out += ", features array<double>" if with_features else ", base_failed boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [statistics(t) for t in part.column(1).to_pylist()]
                counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
                x = np.array([r[1] for r in rows]).reshape(-1, len(FEATURES))
                cols = [part.column(0), *map(pa.array, counts.T.copy())]
                if with_features:
                    cols.append(pa.array(list(x), pa.list_(pa.float64())))
                else:
                    p = trees.probability(x) if trees else np.ones(len(x))
                    cols += [pa.array(base_failed(counts[:, 0], counts[:, 4])), pa.array(p)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0]
                                                              for f in out.split(", ")])

    return d.mapInArrow(run, out)


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
              text_col: str = "text", label_col: str = "quality",
              max_fit: int = MAX_FIT, signs: dict[str, int] | None = None) -> Trees | None:
    """Trees from at most ``max_fit`` labelled documents, or None if too few."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
              .where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_fit))
    # at most max_fit ids, so the sample is broadcast to the documents
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    rows = _measure(sample, "y", "text", None, True).select(
        F.col("doc_id").alias("y"), "features").toArrow()
    y = np.array(rows.column("y").to_pylist(), np.float64)
    if len(y) < LEAST_FIT or y.min() == y.max():
        return None
    x = np.array(rows.column("features").to_pylist())
    order = np.lexsort([*x.T, y])  # the same trees in whatever order rows arrive
    return fit_trees(x[order], y[order], np.array(list((signs or FEATURES).values())))


def judge(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text",
          keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: ``doc_id``, ``COUNTS``, ``base_failed``, ``score`` (the trees'
    probability of good quality) and ``kept``."""
    d = _measure(docs, id_col, text_col, trees, False)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_at))
