"""Vector codes by product quantisation, in exact integer arithmetic.

Components become integers ``floor(SCALE * x)``; a vector is cut into equal parts, and
each part is replaced by the index of its codebook's nearest entry.  Distances must be
exact, or ties and near ties would fall differently from one machine to the next, and
they should run at the speed of float64 matrix products.  Both follow from limbs: an
integer matrix is split into limbs so small that a float64 BLAS product of two of them
stays below 2^53 and hence is exact; the limb products are shifted and added in int64.
``|c|^2 - 2 x c`` then gives the first nearest entry, and ``|x|^2`` the error.

Fitting starts from the smallest ids and runs a fixed number of rounds.  In a round
every task sums its parts by entry, so ``parts * entries`` rows a task shuffle, and the
driver gets ``parts * entries`` sums.  Every vector takes part in every round.

Codes go out with the error of their vector, and with the error of their label: errors
are summed by label (combined in each task), and the sums are joined back by
``operators.skew``, so a label that holds a third of the vectors needs no task of its own.

Edge cases: a vector is dropped if it is null or empty, holds a null, a NaN or an
infinite component, or one of ``LARGEST`` or more in magnitude (whose squared distance
would leave 64 bits); if its length is not a multiple of ``parts``; or if it differs from
that of the kept vector with the smallest id.  A vector of any length is cut into
``parts``; memory follows ``ROWS`` vectors at a time.  Null ids sort after all others,
vectors of one id by their components; repeated rows are ordinary rows; ties in distance
go to the lower index; with fewer vectors than entries the codebooks have fewer entries;
null labels form one group; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import materialize, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of this magnitude or more cannot be coded.
LARGEST = float(1 << 18)
#: Vectors that a worker codes at a time.
ROWS = 1024


@dataclass(frozen=True)
class Codebooks:
    """``entries``: int64 of shape (parts, entries, components a part)."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Lowercase hex digest of all components, comma-joined, in order."""
        joined = ",".join(map(str, self.entries.ravel().tolist()))
        return hashlib.sha256(joined.encode()).hexdigest()


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """``a`` as float64 limbs, lowest first: ``a = sum(limb_i << (i * bits))``.  All but the
    last are in [0, 2^bits); the last has the sign and is in [-2^bits, 2^bits)."""
    out = []
    top = max(int(a.max(initial=0)), -int(a.min(initial=0)))
    while top >> bits:
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a, top = a >> bits, (top >> bits) + 1 if top >> (bits + 1) else top >> bits
    out.append(a.astype(np.float64))
    return out


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x @ c^T`` over the last axes, exact in int64 as long as the result fits."""
    width = x.shape[-1]
    # a sum of ``width`` products of two limbs of at most 2^bits each
    bits = (52 - max(width - 1, 0).bit_length()) // 2
    out = np.zeros((*x.shape[:-1], c.shape[-2]), np.int64)
    c_limbs = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(c_limbs):
            product = np.matmul(a, np.swapaxes(b, -1, -2)).astype(np.int64)
            out += product << ((i + j) * bits)
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each part and its squared distance: ``x`` is (parts, n, width),
    ``books`` (parts, entries, width); both results are (parts, n)."""
    rest = (books * books).sum(-1)[:, None, :] - 2 * exact_products(x, books)
    index = rest.argmin(-1)
    least = np.take_along_axis(rest, index[..., None], -1)[..., 0]
    return index, least + (x * x).sum(-1)


def _parts_of(column: pa.Array, width: int, parts: int) -> Iterator[np.ndarray]:
    """Integer parts (parts, n, width / parts) of up to ``ROWS`` vectors at a time."""
    for at in range(0, len(column), ROWS):
        some = column.slice(at, ROWS)
        flat = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), width)
        yield flat.reshape(len(some), parts, width // parts).transpose(1, 0, 2)


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", parts: int = PARTS,
                 scale: int = SCALE) -> tuple[DataFrame, int]:
    """``(vec_id, label, v)`` of all vectors that can be coded, ``v`` their integers,
    written once, and the vectors' length."""
    v = F.col(vector_col)
    fine = (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(
        v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST))  # NaN is the largest
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = vectors.where(fine).select(F.col(id_col).alias("vec_id"),
                                      F.col(label_col).alias("label"), whole.alias("v"))
    first = good.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    width = first[0] if first else 0
    return materialize(good.where(F.size("v") == width), "vectors"), width


def fit_codebooks(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES,
                  rounds: int = ROUNDS) -> Codebooks:
    """Codebooks over all of ``kept``, from the ``entries`` smallest ids on."""
    ship_package(kept.sparkSession)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width // parts)
    books = books.transpose(1, 0, 2)
    for _ in range(rounds if start else 0):
        books = _moved(kept, books, width)
    return Codebooks(books)


def _moved(kept: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The books after one round: each entry at the floored mean of its parts."""
    parts, entries, part_width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, part_width), np.int64)
        counts = np.zeros(parts * entries, np.int64)
        for b in batches:
            for x in _parts_of(b.column(0), width, parts):
                index, _ = nearest(x, books)
                slot = (index + np.arange(parts)[:, None] * entries).ravel()
                order = np.argsort(slot, kind="stable")
                used, first = np.unique(slot[order], return_index=True)
                sums[used] += np.add.reduceat(x.reshape(-1, part_width)[order], first)
                counts += np.bincount(slot, minlength=len(counts))
        slots, place = (a.ravel() for a in np.indices(sums.shape))
        used = counts[slots] > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots[used].astype(np.int32)), pa.array(place[used].astype(np.int32)),
             pa.array(sums.ravel()[used]), pa.array(counts[slots][used])],
            names=["slot", "place", "total", "n"])

    moved = (kept.select("v").mapInArrow(run, "slot int, place int, total long, n long")
                 .groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
                 .toArrow())  # one row per component of the books at most
    out = books.reshape(-1, part_width).copy()
    out[moved.column("slot").to_numpy(), moved.column("place").to_numpy()] = (
        moved.column("total").to_numpy() // moved.column("n").to_numpy())
    return out.reshape(books.shape)


def encode(kept: DataFrame, width: int, codebooks: Codebooks) -> DataFrame:
    """``vec_id, label, codes, error`` per vector: an index a part (binary, a byte each),
    and the summed squared distance."""
    books = codebooks.entries
    if books.shape[1] > 256:
        raise ValueError("a code is a byte: at most 256 entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = [], []
            for x in _parts_of(b.column(2), width, len(books)):
                index, distance = nearest(x, books)
                codes += [row.tobytes() for row in index.T.astype(np.uint8)]
                errors.append(distance.sum(0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(codes, pa.binary()),
                 pa.array(np.concatenate(errors) if errors else np.empty(0, np.int64))],
                names=["vec_id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.select("vec_id", "label", "v").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error long")


def label_errors(coded: DataFrame, by: str | Column = "label") -> DataFrame:
    """``coded`` (a stored table) with ``label_error``, the errors summed over equal labels."""
    sums = coded.groupBy(by).agg(F.sum("error").alias("label_error"))
    return skew_join(coded, sums, ["label"], how="left", null_safe=True)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """``(vec_id, label, codes, error, label_error)`` per codable vector, and the codebooks."""
    kept, width = kept_vectors(vectors, id_col, vector_col, label_col, parts, scale)
    books = fit_codebooks(kept, width, parts, entries, rounds)
    return label_errors(materialize(encode(kept, width, books), "codes")), books
