"""Helpers shared by the training-data operators: column naming, text
normalisation, and a size-bounded membership bitmap (one-sided filter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: The white space of the contracts: space, tab, LF, VT, FF, CR.
WS = r"[\x20\x09-\x0D]+"
NON_WS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits per block of Spark's bitmap functions (4 KB blocks).
BLOCK_BITS = 32768
#: Largest bitmap that is ever broadcast: 2^28 bits are 32 MB.
MAX_BITMAP_BITS = 1 << 28


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with ``names`` that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(col: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def bitmap_bits(n_rows: int, per_row: int = 16) -> int:
    """A power of two of at least ``per_row`` bits a row, within the broadcast bound.

    Above the bound the filter lets more rows through; no row is ever lost."""
    bits = BLOCK_BITS
    while bits < min(n_rows * per_row, MAX_BITMAP_BITS):
        bits *= 2
    return bits


def bitmap_of(slots: DataFrame, slot: str = "slot") -> DataFrame:
    """``(block, bits)``: one 4 KB bitmap per block of slots, merged map-side.

    At most ``n_bits / 32768`` rows, so its size is bounded by the slot range."""
    return (slots.select(F.expr(f"{slot} div {BLOCK_BITS}").alias("block"),
                         F.expr(f"{slot} % {BLOCK_BITS}").alias("pos"))
                 .groupBy("block").agg(F.bitmap_construct_agg("pos").alias("bits")))


def slot_of(key: Column, seed: int, n_bits: int) -> Column:
    """Slot of a key in a bitmap of ``n_bits``."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n_bits).cast("long"))


def with_bit(df: DataFrame, slot: Column, bitmap: DataFrame, out: str) -> DataFrame:
    """Add boolean ``out``: is the slot's bit set?  The bitmap (at most
    ``MAX_BITMAP_BITS`` bits by construction) is broadcast."""
    block, bits, pos = fresh(df, "_block", "_bits", "_pos")
    b = bitmap.select(F.col("block").alias(block), F.col("bits").alias(bits))
    d = df.withColumn(pos, slot)
    d = d.join(F.broadcast(b), F.expr(f"`{pos}` div {BLOCK_BITS}") == F.col(block), "left")
    byte = F.expr(f"substring(`{bits}`, int(`{pos}` % {BLOCK_BITS} div 8) + 1, 1)")
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(
        F.expr(f"shiftleft(1, int(`{pos}` % 8))"))
    return d.withColumn(out, F.coalesce(bit != 0, F.lit(False))).drop(block, bits, pos)


def content_key(id_col: str | Column, text: Column) -> Column:
    """A 256-bit key of a row's id and text; rows that share it are repeated rows."""
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.sha2(F.concat_ws(":", i.cast("string"), text), 256)


def remove_losers(docs: DataFrame, key: Column, losing: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``losing`` (``key, keeps``) names.

    ``keeps`` is 0 where every row of the key goes, 1 where one of its repeated
    rows stays.  The losing keys form a bitmap; only rows that hit it shuffle
    for the exact comparison, so other texts are not moved."""
    k, hit, keeps = fresh(docs, "_key", "_hit", "_keeps")
    losing = materialize(losing.select(F.col("key").alias(k), F.col("keeps").alias(keeps)),
                         "losing")
    n_bits = bitmap_bits(losing.count())
    slot = slot_of(F.col(k), 5, n_bits)
    bitmap = materialize(bitmap_of(losing.select(slot.alias("slot"))), "losing-slots")
    d = with_bit(docs.withColumn(k, key), slot, bitmap, hit)
    tested = d.where(F.col(hit)).drop(hit).join(losing, k, "left")
    parts = [d.where(~F.col(hit)), tested.where(F.col(keeps).isNull()),
             tested.where(F.col(keeps) == 1).dropDuplicates([k])]
    out = [p.select(*[F.col(f"`{c}`") for c in docs.columns]) for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
