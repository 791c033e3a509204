"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of ``(u, v)`` edges with ``u > v``.

    Large: every neighbour above a node moves to the node's smallest neighbour.
    Small: a node and its smaller neighbours move to the smallest of them.
    The minimum is aggregated map-side; joining it back is a shuffle join whose
    heavy node, if any, adaptive execution splits."""
    if large:
        near = edges.select("u", "v").unionByName(
            edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    low = materialize(near.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m")), "star")
    moved = near.join(low, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; the root is the
    component's smallest node.  Rounds grow with the logarithm of the links; each
    writes its edges to the shared folder."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                             .where("u > v").distinct(), "edges")
    state = None
    while True:
        edges = materialize(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
                            .unionByName(roots), "components")
