"""Toxicity by compression distance: zstandard dictionaries trained on ordinary and on
toxic text.

A text is cut into windows of ``WINDOW`` words; each window is compressed once with
either dictionary.  Where the toxic dictionary saves bytes, the window holds what toxic
text has and ordinary text lacks.  How many windows, and what share of them, save at
least 1, 2, ... bytes goes through a logistic calibration.

zstandard trains the ordinary dictionary on windows of ordinary documents and the toxic one
on toxic passages of toxic documents.  A passage is a run of words whose beginnings
(``MIN_STEM`` to ``MAX_STEM`` bytes) occur in clearly more toxic than ordinary documents, as
it stands in a text; a passage of many documents is as many samples.  Near copies among the
sample count once.  When windows are compressed, the toxic dictionary's content comes
before the ordinary one's, with the ordinary one's entropy tables, so lengths are
comparable and differ only by what was learnt from toxic text.  Dictionaries come from two
thirds of the sample, the calibration from the rest.

Bound of the fit: at most ``MAX_FIT`` documents of each class, chosen by a hash of
their id.  Their whole texts are read, in Arrow passes: keys of near copies, document
counts of stems, toxic passages, drawn ordinary windows, and the calibration's features;
only these reach the driver.  The ordinary dictionary has ``BASE_BYTES`` that zstandard picks
from ``PLAIN_DRAWS`` windows, drawn from all of the ordinary documents; the toxic one
follows the sample, with room for all passages.  The bounds are parameters of ``fit_on``.
Scoring reads whole texts, with no bound.

Edge cases: null and empty texts score as texts without windows; a very long text is
scored by all of its windows, like any other; null labels are not used; with fewer than
``LEAST_FIT`` documents of a class, or too little text for a dictionary, every score is the
share of toxic labels; null ids are not held out; ties in a score mean nothing here, as
nothing is ranked; an empty table gives no rows; repeated rows score alike; extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

WINDOW = 8
MAX_WINDOW_BYTES = 512
MAX_FIT = 3000
LEAST_FIT = 12
BASE_BYTES = 32768
PLAIN_DRAWS = 120_000
#: Passages are short: the trainer picks segments of this size by runs of this many bytes.
SEGMENT, RUN = 32, 8
#: Counted stems that a worker holds before it passes them on.
MAX_COUNTED = 200_000
MIN_STEM, MAX_STEM = 4, 10
SAVED = (1, 2, 3, 4, 5, 6, 8, 10)
#: Fixed value of the zstandard dictionary format: the three first repeat offsets,
#: 1, 4 and 8, end the header; the passages follow.
HEADER_END = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def windows_of(words: list[bytes]) -> list[bytes]:
    out = []
    for i in range(0, len(words), WINDOW):
        w = b" " + b" ".join(words[i:i + WINDOW])
        out.extend(w[j:j + MAX_WINDOW_BYTES] for j in range(0, len(w), MAX_WINDOW_BYTES))
    return out


def _compressor(dictionary: bytes, size: int):
    import zstandard as zs
    params = zs.ZstdCompressionParameters.from_level(
        3, source_size=128, dict_size=size, strategy=zs.STRATEGY_BTOPT, min_match=3,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zs.ZstdCompressionDict(dictionary)
    d.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(compression_params=params, dict_data=d)


@dataclass
class Model:
    """Two dictionaries and the calibration; ``share`` scores when there are none."""

    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.empty(0))
    scale: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    share: float = 0.0

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def saved(self, words: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves, for each window."""
        if self._pair is None:
            self._pair = tuple(_compressor(d, len(self.toxic))
                               for d in (self.ordinary, self.toxic))
        a, b = self._pair
        return np.array([len(a.compress(w)) - len(b.compress(w)) for w in windows_of(words)],
                        np.float64)

    def features(self, words: list[bytes]) -> np.ndarray:
        d = self.saved(words)
        if not len(d):
            d = np.zeros(1)
        at = np.array([(d >= t).sum() for t in SAVED], np.float64)
        return np.concatenate([np.log1p(at), np.log(100 * at / len(d) + 0.3),
                               [d.max(), d.mean()]])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.c_[(rows - self.mean) / self.scale, np.ones(len(rows))]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def _copy_keys(words: list[bytes]) -> list[bytes]:
    """Three minima over word triples; nearly all near copies share one."""
    import xxhash
    triples = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    return [min(xxhash.xxh3_64_digest(t, s) for t in triples) for s in range(3)]


def _distinct(docs: list[tuple[int, list[bytes]]]) -> list[int]:
    """Numbers of the documents that share no key with an earlier one."""
    seen: set = set()
    out = []
    for n, keys in docs:
        keys = set(enumerate(keys))
        if not keys & seen:
            out.append(n)
        seen |= keys
    return out


def _stems(words) -> set[bytes]:
    return {w[:k] for w in set(words) for k in range(MIN_STEM, MAX_STEM + 1) if len(w) >= k}


def _texts(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[tuple[int, int, list[bytes]]]:
    """Number, label and words of the wanted rows of ``n, y, text``, one text at a time."""
    for b in batches:
        for i in range(b.num_rows):
            n = b.column(0)[i].as_py()
            if wanted is None or n in wanted:
                yield n, b.column(1)[i].as_py(), words_of(b.column(2)[i].as_py())


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _profiles(sample: DataFrame) -> list[dict]:
    """``n, y, keys, windows``: near-copy keys and the count of windows of each text."""
    types = [pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, y, words in _texts(batches, None):
            yield _rows(["n", "y", "keys", "windows"], types,
                        [(n, y, _copy_keys(words), len(windows_of(words)))])

    rows = sample.mapInArrow(run, "n int, y int, keys array<binary>, windows long")
    return sorted(rows.toArrow().to_pylist(), key=lambda r: r["n"])


def _marked_stems(sample: DataFrame, train: dict[int, set[int]]) -> set[bytes]:
    """Stems that occur in clearly more toxic than ordinary documents."""
    both = train[0] | train[1]
    types = [pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for _, y, words in _texts(batches, both):
            counted.update((stem, y) for stem in _stems(words))
            if len(counted) > MAX_COUNTED:
                yield _rows(["stem", "y", "c"], types, [(*k, c) for k, c in counted.items()])
                counted.clear()
        yield _rows(["stem", "y", "c"], types, [(*k, c) for k, c in counted.items()])

    n, m = len(train[1]), len(train[0])
    t, o = (F.sum(F.when(F.col("y") == v, F.col("c")).otherwise(0)) for v in (1, 0))
    a, b = F.col("t") / n, (F.col("o") + 1) / (m + 1)
    stems = (sample.mapInArrow(run, "stem binary, y int, c long").groupBy("stem")
             .agg(t.alias("t"), o.alias("o"))
             .where((F.col("t") >= max(4, 0.008 * n)) & (a >= 8 * b)
                    & (a - b >= 10 * F.sqrt(b * (1 - b) / n))))
    return set(stems.select("stem").toArrow().column(0).to_pylist())


def _runs(words: list[bytes], marked) -> set[bytes]:
    """Stretches of marked words, as they stand in the text."""
    out, run = set(), []
    for w in [*words, None]:
        if w is not None and marked(w):
            run.append(w)
        else:
            if run:
                out.add(b" " + b" ".join(run))
            run = []
    return out


def _training_text(sample: DataFrame, train: dict[int, set[int]], stems: set[bytes],
                   n_plain: int, plain_draws: int) -> tuple[list[bytes], list[bytes]]:
    """Toxic passages, each once per document that has it; and ``plain_draws`` of the ordinary
    documents' ``n_plain`` windows, drawn by a hash of document and window."""
    import xxhash
    both = train[0] | train[1]
    below = int(min(1.0, 1.2 * plain_draws / max(1, n_plain)) * 2**64)
    types = [pa.binary(), pa.binary()]

    def is_marked(w: bytes) -> bool:
        return any(w[:k] in stems for k in range(MIN_STEM, MAX_STEM + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, y, words in _texts(batches, both):
            if y:  # passages have no hash
                out = [(r, None) for r in _runs(words, is_marked)]
            else:
                drawn = ((w, xxhash.xxh3_64_digest(w, n)) for w in windows_of(words))
                out = [(w, h) for w, h in drawn if int.from_bytes(h, "big") < below]
            yield _rows(["text", "h"], types, out)

    rows = (sample.mapInArrow(run, "text binary, h binary").groupBy("text", "h").count()
                  .toArrow().to_pylist())
    toxic = sorted((r["count"], r["text"]) for r in rows if not r["h"])
    plain = sorted((r["h"], r["text"]) for r in rows if r["h"])
    return [t for c, t in toxic for _ in range(c)], [w for _, w in plain[:plain_draws]]


def _content(dictionary: bytes) -> bytes:
    """A dictionary without its header."""
    return dictionary[dictionary.index(HEADER_END) + len(HEADER_END):]


def _held_features(sample: DataFrame, held: set[int],
                   model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the held texts, by number."""
    types = [pa.int32(), pa.int32(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, y, words in _texts(batches, held):
            yield _rows(["n", "y", "x"], types, [(n, y, list(model.features(words)))])

    rows = sample.mapInArrow(run, "n int, y int, x array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: r["n"])
    return np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], np.float64)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (w * (y - p)) - 0.1 * b)
    return b


def fit(sample: DataFrame, share: float, base_bytes: int = BASE_BYTES,
        plain_draws: int = PLAIN_DRAWS) -> Model:
    """A model from a labelled sample ``n, y, text`` of distinct numbers ``n``, read more
    than once; ``share`` is the share of toxic labels overall."""
    import zstandard as zs
    ship_package(sample.sparkSession)
    profiles = _profiles(sample)
    by = {v: [r for r in profiles if r["y"] == v] for v in (0, 1)}
    if min(map(len, by.values())) < LEAST_FIT:
        return Model(share=share)
    train = {v: set(_distinct([(r["n"], r["keys"]) for i, r in enumerate(d) if i % 3]))
             for v, d in by.items()}
    stems = _marked_stems(sample, train)
    toxic, plain = _training_text(sample, train, stems,
                                  sum(r["windows"] for r in by[0] if r["n"] in train[0]),
                                  plain_draws)
    try:
        base = zs.train_dictionary(base_bytes, plain).as_bytes()
        room = 1024 + 2 * sum(map(len, set(toxic)))
        learnt = _content(zs.train_dictionary(room, toxic, k=SEGMENT, d=RUN, split_point=1.0)
                          .as_bytes())
    except (zs.ZstdError, ValueError):  # too little text for a dictionary
        return Model(share=share)
    model = Model(base, base.removesuffix(_content(base)) + learnt + _content(base), share=share)
    x, y = _held_features(sample, {r["n"] for d in by.values() for r in d[::3]}, model)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic(np.c_[(x - model.mean) / model.scale, np.ones(len(x))], y, weight)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, usable: Column | None = None,
           id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           max_fit: int = MAX_FIT, base_bytes: int = BASE_BYTES,
           plain_draws: int = PLAIN_DRAWS) -> Model:
    """Fit on at most ``max_fit`` labelled documents of each class for which
    ``usable``, a condition on the id, holds; ``base_bytes`` bounds the ordinary dictionary,
    ``plain_draws`` the windows that it is trained on."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    marked = marked.where("id is not null and y in (0, 1)")
    if usable is not None:
        marked = marked.withColumnRenamed("id", id_col).where(usable).withColumnRenamed(
            id_col, "id")
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model()
    chosen = None
    for v in (0, 1):
        part = marked.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(max_fit)
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * max_fit ids at most, numbered in the order of their hash and broadcast
    chosen = chosen.orderBy(F.xxhash64("id"), "id").select(F.col("id").alias("_id"), "y").toArrow()
    chosen = chosen.append_column("n", pa.array(range(chosen.num_rows), pa.int32()))
    chosen = docs.sparkSession.createDataFrame(chosen)
    sample = (docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
                  .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
                  .groupBy("n").agg(F.first("y").alias("y"), F.min("text").alias("text")))
    return fit(materialize(sample, "toxicity-sample"), counts.get(1, 0) / total, base_bytes,
               plain_draws)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every document, from its whole text alone."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                if len(model.weights):
                    s = model.scores(np.array([model.features(words_of(t))
                                               for t in part.column(1).to_pylist()]))
                else:
                    s = np.full(part.num_rows, model.share)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)],
                                                 names=["doc_id", "score"])

    return d.mapInArrow(run, f"doc_id {id_type}, score double")
