"""Mixing sources to target weights along a time-varying curriculum
(DataFrame functions only).

Source ``s`` is to supply ``target_s`` words over training time 0..1.  Its
weight schedule is linear in time, ``r_s(t) = target_s * (1 + slope_s * (1 - 2t))``,
with slopes from +0.5 (first source: early) to -0.5 (last source: late).  Its
integral is the cumulative demand ``D_s(t) = target_s * (t + slope_s * (t - t^2))``
with ``D_s(1) = target_s``.  A source's documents in hash order, repeated for as
many passes as the target needs, form its word stream.  A document whose words
begin at word ``c`` of the stream is due when ``D_s(t) = c``: inverting the
demand gives its training position, and range-sorting by position gives the
training order.

Targets are the weights' shares of all words, except that no source gives more
than ``max_passes`` times its own words; the excess goes to the others by
weight.  The last document is cut, so a source gives its target to the word.

Scale: texts are read once, for word counts and a hash.  Prefix sums never sort
a whole source in one task: documents fall by hash into buckets of about
``BUCKET_ROWS`` rows, buckets are summed map-side, and only a bucket's rows meet.

Edge cases: null text has size 0 and is never taken; null is a source of its
own, last; rows equal in id, source and text follow each other in the stream; equal
positions are ordered by hash; a very long text is one number of words, and is cut like
any other where its source's target ends; an empty table gives no rows; extra columns stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import NON_WS, fresh, text_of

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: Rows that a bucket holds on average; a bucket is sorted in one task.
BUCKET_ROWS = 20_000


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(NON_WS)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """``source, source_size, target, slope`` from ``(source, source_size)``.

    Filling by weight up to a limit: in order of limit / weight, a prefix of
    the sources is held at its limit and the rest share what is left at one
    level.  The table has a row per source."""
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    d = sizes.select("source", "source_size", w.alias("w"),
                     (F.row_number().over(order) - 1).alias("k"),
                     F.count(F.lit(1)).over(everything).alias("n"),
                     (F.col("source_size") * max_passes).alias("cap"))
    by_ratio = everything.orderBy(F.col("cap") / F.col("w"), "k")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(
        0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before),
                                                                 F.lit(0)))
             / F.sum("w").over(rest))
    d = d.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("w") <= F.col("cap"))
    # the first source that stays below its limit fixes the level of all after it
    held = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, 0))
    slope = F.when(F.col("n") > 1, 0.5 - F.col("k") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return d.select("source", "source_size",
                    F.coalesce(held * F.col("w"), F.col("cap").cast("double")).alias("target"),
                    slope.alias("slope"))


def demand_time(share: Column, slope: Column) -> Column:
    """The time at which a source has had ``share`` of its demand: the root in
    0..1 of ``t + slope * (t - t^2) = share``, in a form that is stable at slope 0."""
    b = 1 + slope
    return 2 * share / (b + F.sqrt(b * b - 4 * slope * share))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per document: ``doc_id, source, h, size, source_size, target, slope,
    before`` (words of its source before it), ``taken`` and ``position`` (of its
    first copy; null if none is taken), range-sorted by position."""
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                    word_count(text_col).alias("size"),
                    F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("h")),
        "sized")
    n_buckets = max(1, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.pmod(F.col("h"), F.lit(n_buckets).cast("long")))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    buckets = materialize(buckets, "buckets")
    prior = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")),
                             weights, max_passes)
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(prior), F.lit(0)))
    starts, targets = materialize(starts, "starts"), materialize(targets, "targets")
    plan = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(
        F.col("t.source"))).select(F.col("b.source").alias("p_source"),
                                   F.col("b.bucket").alias("p_bucket"), "start",
                                   "source_size", "target", "slope")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    d = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(plan, F.col("source").eqNullSafe(F.col("p_source"))
               & (F.col("bucket") == F.col("p_bucket")))
    d = d.withColumn("before", F.col("start") + F.col("inside"))
    quota = F.floor(F.col("target")).cast("long")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), quota - F.col("source_size") * p
                                              - F.col("before"))) for p in range(max_passes)),
                F.lit(0)).cast("long")
    d = d.withColumn("taken", taken)
    d = d.withColumn("position", F.when(F.col("taken") > 0, demand_time(
        F.col("before") / F.col("target"), F.col("slope"))))
    d = d.select("doc_id", "source", "h", "size", "source_size", "target", "slope", "before",
                 "taken", "position")
    return d.sort(F.col("position").asc_nulls_last(), "h")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", weights=WEIGHTS,
             max_passes: int = MAX_PASSES) -> DataFrame:
    """The mixed corpus: ``docs``' columns, a row per copy, range-sorted by training
    position; a copy that passes its source's target is cut after its last word.

    The mix is joined back by id and a hash of id, source and text, so repeated ids are
    safe."""
    k, n, plan, at, copy, words = fresh(docs, "_k", "_n", "_plan", "_at", "_copy", "_words")
    m = mix(docs, id_col, text_col, source_col, weights, max_passes).where("taken > 0")
    order = Window.partitionBy("doc_id", "h").orderBy("before")
    m = materialize(m.select(
        F.struct("doc_id", "h").alias(k), F.row_number().over(order).alias(n),
        F.struct("size", "taken", "before", "source_size", "target", "slope").alias(plan)), "mix")
    ids = F.struct(F.col(id_col).alias("doc_id"),
                   F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("h"))
    # of rows equal in id, source and text the i-th takes the i-th share: number them alike
    many = materialize(m.groupBy(k).count().where("count > 1").select(k), "repeated")
    d = docs.withColumn(k, ids)
    same = F.col(f"{k}.doc_id").eqNullSafe(F.col("many.id")) & (F.col(f"{k}.h") == F.col("many.h"))
    many = many.select(F.col(f"{k}.doc_id").alias("id"), F.col(f"{k}.h").alias("h")).alias("many")
    once = d.join(many, same, "left_anti").withColumn(n, F.lit(1))
    again = d.join(many, same, "left_semi").withColumn(
        n, F.row_number().over(Window.partitionBy(k).orderBy(F.lit(0))))
    p = {c: F.col(f"{plan}.{c}") for c in ("size", "taken", "before", "source_size", "target",
                                           "slope")}
    other = m.select(F.col(k).alias("k"), F.col(n).alias("n"), plan).alias("m")
    d = once.unionByName(again).join(
        other, (F.col(f"{k}.h") == F.col("m.k.h")) & (F.col(n) == F.col("m.n"))
        & F.col(f"{k}.doc_id").eqNullSafe(F.col("m.k.doc_id"))).drop(
        F.col("m.k"), F.col("m.n"))
    d = d.withColumn(copy, F.explode(F.sequence(
        F.lit(0), (F.ceil(p["taken"] / p["size"]) - 1).cast("int"))))
    d = d.withColumn(words, F.least(p["size"], p["taken"] - F.col(copy) * p["size"]))
    pieces = F.split(F.col(text_col), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    lead = F.col(text_col).rlike(r"\A[\x20\x09-\x0D]").cast("int")
    cut_text = F.array_join(F.slice(pieces, F.lit(1), (F.col(words) + lead).cast("int")), "")
    d = d.withColumn(text_col, F.when(F.col(words) < p["size"], cut_text).otherwise(
        F.col(text_col)))
    d = d.withColumn(at, demand_time((p["before"] + F.col(copy) * p["source_size"])
                                     / p["target"], p["slope"]))
    return d.sort(at, k, copy).select(*[F.col(f"`{c}`") for c in docs.columns])
