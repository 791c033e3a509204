"""Equi-joins that hold when one key has a large share of the rows.

A shuffle join sends all rows of a key to one task.  Adaptive execution can split a
large partition, but only where nothing above needs the join's partitioning, and only
after the shuffle has been written.  Here hot keys are found beforehand, by counting,
and dealt over as many join keys as their share calls for:

1. ``rows`` are counted by key (combined in each task).  A key is hot if it holds more
   than one in ``chunks`` of all rows, so there are fewer than ``chunks`` hot keys,
   whatever the data: that small table is broadcast.
2. A hot key with ``n`` of ``N`` rows gets ``ceil(n * chunks / N)`` salts.  Its rows
   are dealt over them in turn, and its rows of the other side are repeated once a salt
   (fewer than ``2 * chunks`` repetitions in all).
3. One plain join on (key, salt) does the rest: no (key, salt) holds more than
   ``N / chunks`` rows, and keys that are not hot keep the one salt 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: No join key is left with more than one in CHUNKS of the rows.
CHUNKS = 1024


def _fresh(stem: str, *frames: DataFrame) -> str:
    taken = {c.lower() for f in frames for c in f.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def _same(left: Sequence[Column], right: Sequence[Column], null_safe: bool) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & (a.eqNullSafe(b) if null_safe else a == b)
    return cond


def hot_keys(rows: DataFrame, on: Sequence[str], chunks: int = CHUNKS,
             salts: str = "_salts") -> DataFrame:
    """Keys of more than one in ``chunks`` of ``rows``, with their number of salts, written
    once: fewer than ``chunks`` rows.  NULL is a key like any other."""
    total = rows.count()
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias(salts))
    hot = counts.where(F.col(salts) * chunks > total)
    return materialize(hot.withColumn(salts, F.ceil(F.col(salts) * chunks / max(total, 1))
                                      .cast("int")), "hot-keys")


def skew_join(rows: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner",
              null_safe: bool = False, chunks: int = CHUNKS) -> DataFrame:
    """``rows JOIN side USING (on)`` with hot keys of ``rows`` dealt over many join keys.

    ``rows`` is read twice, so it should be a stored table.  ``how`` is ``inner`` or
    ``left`` (keeping all ``rows``).  With ``null_safe`` a NULL key meets NULL keys; else it
    meets none, and in a left join rows with a NULL key are dealt out as well.  ``side``
    may hold a key many times.  The result has the columns of ``rows``, then those of
    ``side`` but the keys."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    n, salt = _fresh("_salts", rows, side), _fresh("_salt", rows, side)
    hot = hot_keys(rows, on, chunks, n)
    names = [_fresh(f"_hot{i}", rows, side) for i in range(len(on))]
    hot = F.broadcast(hot.select(*[F.col(c).alias(a) for c, a in zip(on, names)], n))

    def salted(df: DataFrame) -> DataFrame:
        cond = _same([F.col(c) for c in on], [F.col(a) for a in names], True)
        return df.join(hot, cond, "left").withColumn(n, F.coalesce(F.col(n), F.lit(1)))

    dealt = salted(rows).withColumn(
        salt, F.pmod(F.monotonically_increasing_id(), F.col(n)).cast("int"))
    repeated = salted(side).withColumn(
        salt, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    others = [c for c in side.columns if c not in on]
    keys = [_fresh(f"_key{i}", rows, side) for i in range(len(on))]
    right = _fresh("_side_salt", rows, side)
    repeated = repeated.select(*[F.col(c).alias(k) for c, k in zip(on, keys)],
                               F.col(salt).alias(right), *others)
    cond = _same([F.col(c) for c in on], [F.col(k) for k in keys], null_safe)
    joined = dealt.join(repeated, cond & (F.col(salt) == F.col(right)), how)
    return joined.select(*rows.columns, *others)
