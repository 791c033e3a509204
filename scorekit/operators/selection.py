"""Exact rows at given positions of an order, without sorting the rows.

A tile border, a median or the last row of a top share is the row at one position of a
group's order.  To find such rows, sorting the whole table is far too much work:

1. One aggregation keeps a quantile sketch per group and order.  Its values a little
   before and after each wanted position enclose the row that is looked for.
2. In one histogram round over all groups and positions (a scan an order), rows outside
   the intervals collapse to a count per gap (in each task, before they shuffle); only rows
   inside, about ``2 * MARGIN`` of them a position, and ties, keep their sort keys.
3. The histogram is numbered by :func:`group_positions` with the counts as weights, so
   every entry knows its exact position, and the wanted rows are read off.

Positions are exact: the sketch only decides which rows keep their keys, and if a wanted
position falls into a gap the round is repeated with nothing collapsed.

Rows are then told apart by comparing their sort keys with those of the border rows
(:func:`at_or_before`), so tiles need no sort of the rows at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..session import materialize, with_scalars
from .positions import Order, group_positions

#: How far around a position the sketch's interval reaches, as a share of the rows.
MARGIN = 0.002
#: The sketch's error is 1 / ACCURACY of the rows, well within the margin.
ACCURACY = 2000


@dataclass(frozen=True)
class Cuts:
    """Positions (from 1) wanted in one order of each group's rows.

    ``shares`` says about where they are; ``positions`` gives them exactly from a group's
    row count, in ascending order.  ``order`` need not end in a unique key: rows that it
    ties are one entry, which is found for each of its positions."""

    name: str
    order: Order
    shares: Sequence[float]
    positions: Callable[[Column], Sequence[Column]]


def tile_ends(name: str, order: Order, k: int, first: int | None = None) -> Cuts:
    """Last rows of the tiles ``1..k-1`` of NTILE(k) (or only of the ``first`` ones)."""
    ends = range(1, (first or k - 1) + 1)

    def positions(n: Column) -> list[Column]:
        q, r = F.floor(n / k).cast("long"), (n % k).cast("long")
        return [j * q + F.least(F.lit(j).cast("long"), r) for j in ends]
    return Cuts(name, order, [j / k for j in ends], positions)


def middle(name: str, column: str) -> Cuts:
    """The lower and the upper middle value of a column without NULLs."""
    return Cuts(name, [(column, "asc")], [0.5],
                lambda n: [F.floor((n + 1) / 2).cast("long"), F.floor(n / 2).cast("long") + 1])


def median_of(name: str) -> Column:
    """The median of a row that has ``_cuts`` with :func:`middle` ``name``."""
    pair = [F.col(f"_cuts.{name}_{i}")["k0"].cast("double") for i in (0, 1)]
    return (pair[0] + pair[1]) / 2


def _image(df: DataFrame, order: Order) -> Column:
    """A double that never falls along the order (rows of one image may differ)."""
    name, direction = order[0]
    kind = df.schema[name].dataType
    if isinstance(kind, DateType):
        x = F.unix_date(name).cast("double")
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        x = F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    elif isinstance(kind, NumericType):
        x = F.col(name).cast("double")
    else:
        return F.lit(0.0)
    x = F.when(F.isnan(x), float("inf")).otherwise(x)  # NaN sorts above all numbers
    last = direction.lower() == "desc"
    return F.coalesce(-x if last else x, F.lit(float("inf") if last else -float("inf")))


def _attach(rows: DataFrame, table: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """``table``, one row per group (NULL is a group), as struct ``name`` of its other columns."""
    if not group:
        return with_scalars(rows, table, name)
    keys = [f"_g{i}" for i in range(len(group))]
    side = table.select(*[F.col(g).alias(k) for g, k in zip(group, keys)],
                        F.struct(*[c for c in table.columns if c not in group]).alias(name))
    cond = F.lit(True)
    for g, k in zip(group, keys):
        cond = cond & F.col(g).eqNullSafe(F.col(k))
    return rows.join(side, cond).drop(*keys)


def _intervals(df: DataFrame, group: Sequence[str], cuts: Sequence[Cuts], label: str) -> DataFrame:
    """Per group ``_c{i}``: interval starts and ends of each wanted position, alternating."""
    aggs = []
    for i, c in enumerate(cuts):
        shares = [p for s in c.shares for p in (max(0.0, s - MARGIN), min(1.0, s + MARGIN))]
        aggs.append(F.percentile_approx(_image(df, c.order), shares, ACCURACY).alias(f"_c{i}"))
    return materialize(df.groupBy(*group).agg(*aggs), label + "-sketch")


def _histogram(df: DataFrame, group: Sequence[str], cuts: Sequence[Cuts],
               bounds: DataFrame | None) -> DataFrame:
    """``_cut, group, _place, _kept, keys..., _count``: entries inside the intervals with
    their keys, and one entry per gap outside.  Without ``bounds`` all entries are kept."""
    rows = df if bounds is None else _attach(df, bounds, group, "_bounds")
    parts = []
    for i, c in enumerate(cuts):
        r = rows.withColumn("_x", _image(df, c.order))
        if bounds is None:
            r = r.withColumns({"_place": F.lit(0), "_kept": F.lit(True)})
        else:
            ends = [F.col(f"_bounds._c{i}")[j] for j in range(2 * len(c.shares))]
            r = r.withColumns({
                "_begun": sum(((F.col("_x") >= e).cast("int") for e in ends[::2]), F.lit(0)),
                "_over": sum(((F.col("_x") > e).cast("int") for e in ends[1::2]), F.lit(0))})
            # both follow the order
            r = r.withColumns({"_place": F.col("_begun") + F.col("_over"),
                               "_kept": F.col("_begun") > F.col("_over")})
        keys = [F.when(F.col("_kept"), F.col(name)).alias(f"_k{k}_{j}") if k == i
                else F.lit(None).cast(df.schema[name].dataType).alias(f"_k{k}_{j}")
                for k, other in enumerate(cuts) for j, (name, _) in enumerate(other.order)]
        r = r.select(F.lit(i).alias("_cut"), *group, "_place", "_kept", *keys)
        parts.append(r.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rows_at(df: DataFrame, group: Sequence[str], cuts: Sequence[Cuts],
            label: str = "cuts", exhaustive: bool = False) -> DataFrame:
    """One row per group: ``{name}_n``, its row count, and for each position of each of
    ``cuts`` the sort key at it, a struct ``{name}_{i}`` of ``k0, k1, ...`` (written once).

    ``df`` is read once for the sketches and once an order, so it should be cheap to read.
    ``exhaustive`` skips the sketch and keeps every entry."""
    group = list(group)
    bounds = None if exhaustive else _intervals(df, group, cuts, label)
    hist = _histogram(df, group, cuts, bounds)
    order = [("_place", "asc"), *[(f"_k{i}_{j}", d) for i, c in enumerate(cuts)
                                  for j, (_, d) in enumerate(c.order)]]
    pos = group_positions(hist, ["_cut", *group], order, F.col("_count"), label)
    wanted = F.lit(None)
    for i, c in enumerate(cuts):
        at = F.array(*c.positions(F.col("_total")))
        wanted = F.when(F.col("_cut") == i, at) if i == 0 else wanted.when(F.col("_cut") == i, at)
    first, last = F.col("_before") + 1, F.col("_before") + F.col("_count")
    keys = [c for c in hist.columns if c.startswith("_k") and c != "_kept"]
    found = (pos.select("_cut", *group, "_kept", "_total", *keys,
                        F.posexplode(wanted).alias("_i", "_at"), first.alias("_first"),
                        last.alias("_last"))
                .where("_at between _first and _last"))
    out = [F.count(F.when(~F.col("_kept"), 1)).alias("_missed")]
    for i, c in enumerate(cuts):
        here = F.col("_cut") == i
        out.append(F.max(F.when(here, F.col("_total"))).alias(f"{c.name}_n"))
        key = F.struct(*[F.col(f"_k{i}_{j}").alias(f"k{j}") for j in range(len(c.order))])
        out += [F.any_value(F.when(here & (F.col("_i") == j), key), True).alias(f"{c.name}_{j}")
                for j in range(len(c.positions(F.lit(1))))]
    rows = materialize(found.groupBy(*group).agg(*out), label + "-rows")
    if not exhaustive and not rows.where("_missed > 0").isEmpty():
        return rows_at(df, group, cuts, label, exhaustive=True)
    return rows.drop("_missed")


def at_or_before(order: Order, border: Column) -> Column:
    """Is the row's sort key at or before that of ``border`` (a struct of ``rows_at``)?
    NULLs sort as in :func:`order_exprs`."""
    out = F.lit(True)
    for j, (name, direction) in reversed(list(enumerate(order))):
        x, b = F.col(name), border[f"k{j}"]
        if direction.lower() == "desc":  # NULLs last
            less = F.when(x.isNull(), False).when(b.isNull(), True).otherwise(x > b)
        else:
            less = F.when(b.isNull(), False).when(x.isNull(), True).otherwise(x < b)
        out = less | (x.eqNullSafe(b) & out)
    return out


def with_cuts(df: DataFrame, group: Sequence[str], cuts: Sequence[Cuts],
              label: str = "cuts") -> DataFrame:
    """``df`` with struct ``_cuts``: the row of :func:`rows_at` of each row's group."""
    return _attach(df, rows_at(df, group, cuts, label), group, "_cuts")


def tile_of(cuts: Cuts, k: int) -> Column:
    """NTILE(k) of a row that has ``_cuts`` with all ``tile_ends(..., k)``."""
    return sum(((~at_or_before(cuts.order, F.col(f"_cuts.{cuts.name}_{j}"))).cast("int")
                for j in range(k - 1)), F.lit(1))
