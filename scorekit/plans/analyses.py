"""The fourteen analyses over a companies-shaped DataFrame.

Every analysis takes the entity DataFrame (columns of ``schema.COMPANIES``)
and returns a result DataFrame; intermediate tables that must be read more than once
are written while it is built.  Column roles default to the companies
table but can be pointed at other columns (``group``, ``score``, ``weight``,
...).  ``as_of_year`` replaces ``YEAR(CURDATE())``; ``None`` means the
current year.

Scale notes
-----------
* Per-group windows over base rows (NTILE, full ROW_NUMBER/RANK) and exact
  medians go through :mod:`scorekit.operators`: one plan at every size, built on
  global sorts, so a hot group is range-split.  Top-k windows rely on the
  partial ``WindowGroupLimit`` Catalyst inserts before the shuffle.
* Per-group benchmarks are aggregates with map-side combine, written once and
  joined back; Spark picks the join by their bytes.  Global scalars are one
  scalar subquery.
* Native windows remain only over aggregates whose partitions are
  bounded by the label set (age segments, size segments: at most four rows
  per group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    bayesian_score,
    bucket_desc,
    bucket_range,
    exact_avg,
    exact_sum,
    field_position,
    minmax,
    nullsafe_div,
    rank_score,
    round_half_away,
    weighted,
)
from ..operators import (
    at_or_before,
    group_stats,
    median_of,
    median_table,
    middle,
    order_exprs,
    rank_all,
    rank_within,
    ranks_within,
    row_positions,
    tile_ends,
    tile_of,
    topk_within,
    with_cuts,
)
from ..session import join_stored, materialize, with_scalars

# Labels and thresholds of the analyses.
SIZE_CUTS = ((2000, "Large"), (300, "Mid size"))
SIZE_OTHER = "Startup/Small"
AGE_BUCKETS = ((0, 5, "Startup"), (6, 15, "Growth"), (16, 30, "Established"))
AGE_OTHER = "Legacy"
LEADER_ORDER = ("Hidden Leader", "Popular Leader", "Average Performer")
TILE_LABELS = ("Small", "Mid", "Large")
MOST_REVIEWED = "Most Reviewed 10%"
LEAST_REVIEWED = "Least Reviewed 10%"
BIAS_POSITIVE = "Possible positive bias in low-volume reviews"
BIAS_NEGATIVE = "High-volume companies are rated better"
BIAS_NONE = "No visible bias gap"
BALANCED = "Balanced Leader"
MIXED = "Specialist / Mixed Position"


def _year_now(as_of_year: int | None) -> Column:
    return F.year(F.current_date()) if as_of_year is None else F.lit(int(as_of_year))


def _age_rows(df: DataFrame, as_of_year, required: Sequence[str],
zero_year_as_null: bool = False) -> DataFrame:
    """Base rows with a known, non-future founding year and the required columns.

    A missing year stored as 0 counts as known (age ~2000, "Legacy") unless
    ``zero_year_as_null``."""
    now = _year_now(as_of_year)
    cond = F.col("Company_year").isNotNull() & (F.col("Company_year") <= now)
    if zero_year_as_null:
        cond = cond & (F.col("Company_year") != 0)
    for c in required:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond).withColumn("company_age", now - F.col("Company_year"))


def case_insensitive(df: DataFrame, cols: Sequence[str] = ("Country",),
                     collation: str = "UTF8_LCASE") -> DataFrame:
    """Give grouping columns a case-insensitive collation (MySQL's default
    behaviour): every later GROUP BY / PARTITION BY / join / sort on them then
    treats 'India' and 'india' as one key.  Use ``"UNICODE_CI_AI"`` to ignore
    accents as well."""
    return df.withColumns({c: F.collate(F.col(c), collation) for c in cols})


def _not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond)


# --------------------------------------------------------------------------
# Q1 / Q2: ordered listings


def top_rated(df: DataFrame, min_reviews: int | None = None, k: int | None = None,
              by: Sequence[tuple[str, str]] = (("Rating", "desc"), ("RatingCount", "desc")),
              key: str = "id") -> DataFrame:
    """All rows by rating then review count; optional review floor and top-k."""
    rows = df if min_reviews is None else df.filter(F.col("RatingCount") >= min_reviews)
    order = list(by) + ([(key, "asc")] if k is not None else [])
    out = rows.orderBy(*order_exprs(order))
    return out.limit(k) if k is not None else out


def low_review_bias(df: DataFrame) -> DataFrame:
    """Highly rated first, fewest reviews first among equal ratings."""
    return df.orderBy(*order_exprs([("Rating", "desc"), ("RatingCount", "asc")]))


def in_group(df: DataFrame, value: str, group: str = "Country", key: str = "id") -> DataFrame:
    """The rows of one group, in key order."""
    return df.filter(F.col(group) == value).orderBy(*order_exprs([(key, "asc")]))


def first_rows(df: DataFrame, k: int = 5, key: str = "id") -> DataFrame:
    """The first ``k`` rows in key order."""
    return df.orderBy(*order_exprs([(key, "asc")])).limit(k)


# --------------------------------------------------------------------------
# Q3: rating by country and size class


def size_distribution(df: DataFrame, cuts=SIZE_CUTS, other: str = SIZE_OTHER,
                      group: str = "Country", size: str = "Employees_Count",
                      score: str = "Rating") -> DataFrame:
    return (df.groupBy(F.lower(F.trim(F.col(group))).alias(group),
                       bucket_desc(size, cuts, other).alias("company_size"))
              .agg(round_half_away(exact_avg(score), 2).alias("AverageRating"))
              .orderBy(F.col("AverageRating").desc_nulls_last()))


# --------------------------------------------------------------------------
# Q4: credibility-adjusted ranking, top k per group


def credibility_rank(df: DataFrame, group: str = "Country", score: str = "Rating",
                     weight: str = "RatingCount", name: str = "Name", k: int = 5) -> DataFrame:
    base = _not_null(df, [score, weight]).select(name, group, score, weight)
    stats = base.agg(exact_avg(score).alias("prior_mean"),
                     exact_avg(weight, 0).alias("prior_weight"))
    scored = with_scalars(base, stats).withColumn(
        "credibility_score",
        round_half_away(bayesian_score(score, weight, "_g.prior_mean", "_g.prior_weight"), 3))
    ranked = topk_within(scored, [group],
                         [("credibility_score", "desc"), (weight, "desc"), (name, "asc")],
                         k, "country_rank", method="rank")
    return (ranked.select(group, name, score, weight, "credibility_score",
                          F.col("country_rank").cast("long").alias("country_rank"))
                  .orderBy(F.col(group).asc_nulls_first(), "country_rank",
                           F.col("credibility_score").desc()))


# --------------------------------------------------------------------------
# Q5: hidden vs popular leaders


def leader_classes(df: DataFrame, group: str = "Country", score: str = "Rating",
                   weight: str = "RatingCount", name: str = "Name", key: str = "id",
                   tiles: int = 4) -> DataFrame:
    # rows without a group would not meet its median
    base = _not_null(df, [score, weight, group]).select(key, name, group, score, weight)
    order = [(score, "desc"), (weight, "desc"), (name, "asc"), (key, "asc")]
    # the last row of tile 1 and both middle weights, found in one histogram round
    leaders = tile_ends("leader", order, tiles, first=1)
    bench = with_cuts(base, [group], [leaders, middle("median", weight)], "q5-cuts")
    w, med = F.col(weight), F.col("median_ratingcount")
    top = at_or_before(order, F.col("_cuts.leader_0"))
    classified = (bench.withColumn("median_ratingcount", median_of("median"))
                  .withColumn("performance_group",
                              F.when(top & (w < med), LEADER_ORDER[0])
                               .when(top & (w >= med), LEADER_ORDER[1])
                               .otherwise(LEADER_ORDER[2]))
                  .withColumn("review_gap_to_median", round_half_away(med - w, 2))
                  .drop("_cuts"))
    # every row's rank is asked for: one sort, by (group, class)
    ranked = row_positions(classified, [group, "performance_group"], order,
                           "segment_rank", "_seg_n", label="q5-rank")
    return (ranked.select(group, name, score, weight, "median_ratingcount", "performance_group",
                          "review_gap_to_median", F.col("segment_rank").cast("long"))
                  .orderBy(group, field_position("performance_group", LEADER_ORDER),
                           "segment_rank"))


# --------------------------------------------------------------------------
# Q6: strongest age segment per group


def age_segments(df: DataFrame, as_of_year: int | None = None, buckets=AGE_BUCKETS,
                 other: str = AGE_OTHER, weights=(0.70, 0.30),
                 group: str = "Country",
                 zero_year_as_null: bool = False) -> DataFrame:
    base = _age_rows(df, as_of_year, ["Rating", "Employees_Count"],
                     zero_year_as_null).withColumn(
        "age_segment", bucket_range("company_age", buckets, other))
    seg = base.groupBy(group, "age_segment").agg(
        F.count(F.lit(1)).alias("company_count"),
        round_half_away(exact_avg("company_age", 0), 1).alias("avg_company_age"),
        round_half_away(exact_avg("Rating"), 3).alias("avg_rating"),
        round_half_away(exact_avg("Employees_Count", 0), 0).alias("avg_employees"))
    # at most len(buckets)+1 rows per group: the window partition is bounded
    w = Window.partitionBy(group)
    strength = weighted([
        (weights[0], minmax("avg_rating", F.min("avg_rating").over(w), F.max("avg_rating").over(w))),
        (weights[1], minmax("avg_employees", F.min("avg_employees").over(w),
                            F.max("avg_employees").over(w))),
    ])
    scored = seg.withColumn("segment_strength_score", round_half_away(strength, 4))
    ranked = scored.withColumn("segment_rank", F.dense_rank().over(
        Window.partitionBy(group).orderBy(*order_exprs([
            ("segment_strength_score", "desc"), ("avg_rating", "desc"),
            ("avg_employees", "desc")]))).cast("long"))
    return (ranked.select(group, "age_segment", "company_count", "avg_company_age", "avg_rating",
                          "avg_employees", "segment_strength_score", "segment_rank")
                  .orderBy(F.col(group).asc_nulls_first(), "segment_rank", "age_segment"))


# --------------------------------------------------------------------------
# Q7: overperformers per global size tile


def overperformers(df: DataFrame, tiles: int = 3, labels=TILE_LABELS, margin: float = 0.50,
                   k: int = 3, size: str = "Employees_Count", score: str = "Rating",
                   name: str = "Name", key: str = "id") -> DataFrame:
    base = _not_null(df, [score, size]).select(key, name, "Country", score, size)
    ends = tile_ends("size", [(size, "asc"), (name, "asc"), (key, "asc")], tiles)
    tiled = with_cuts(base, [], [ends], "q7-cuts").withColumn("size_bucket_no",
                                                              tile_of(ends, tiles)).drop("_cuts")
    label = F.lit(labels[-1])
    for i in range(len(labels) - 1, 0, -1):
        label = F.when(F.col("size_bucket_no") == i, labels[i - 1]).otherwise(label)
    labeled = tiled.withColumn("size_segment", label)
    # one row per tile label: a size bound known before running
    bench = labeled.groupBy("size_segment").agg(
        round_half_away(exact_avg(score), 3).alias("segment_avg_rating"))
    over = (labeled.join(F.broadcast(bench), "size_segment")
                   .filter(F.col(score) >= F.col("segment_avg_rating") + margin)
                   .withColumn("rating_lift",
                               round_half_away(F.col(score) - F.col("segment_avg_rating"), 3)))
    ranked = topk_within(over, ["size_segment"],
                         [("rating_lift", "desc"), (score, "desc"), (size, "desc"),
                          (name, "asc"), (key, "asc")], k, "segment_rank")
    return (ranked.select("size_segment", name, "Country", score, size, "segment_avg_rating",
                          "rating_lift", F.col("segment_rank").cast("long"))
                  .orderBy("size_segment", "segment_rank"))


# --------------------------------------------------------------------------
# Q8: review-volume bias per group


def review_bias(df: DataFrame, tiles: int = 10, group: str = "Country", score: str = "Rating",
                weight: str = "RatingCount", name: str = "Name", key: str = "id") -> DataFrame:
    base = _not_null(df, [score, weight]).select(key, name, group, score, weight)
    # only the first tiles of both directions are wanted: two border rows per group,
    # found in one round; no row is sorted or numbered
    most = tile_ends("most", [(weight, "desc"), (name, "asc"), (key, "asc")], tiles, first=1)
    least = tile_ends("least", [(weight, "asc"), (name, "asc"), (key, "asc")], tiles, first=1)
    cut = with_cuts(base, [group], [most, least], "q8-cuts")
    extreme = cut.withColumn("review_group", F.when(
        at_or_before(most.order, F.col("_cuts.most_0")), MOST_REVIEWED).when(
        at_or_before(least.order, F.col("_cuts.least_0")), LEAST_REVIEWED)).where(
        F.col("review_group").isNotNull())
    is_most = F.col("review_group") == MOST_REVIEWED
    is_least = F.col("review_group") == LEAST_REVIEWED
    summary = extreme.groupBy(group).agg(
        F.count(F.when(is_most, 1)).alias("most_reviewed_company_count"),
        F.count(F.when(is_least, 1)).alias("least_reviewed_company_count"),
        round_half_away(exact_avg(F.when(is_most, F.col(score))), 3)
        .alias("avg_rating_most_reviewed"),
        round_half_away(exact_avg(F.when(is_least, F.col(score))), 3)
        .alias("avg_rating_least_reviewed"),
        round_half_away(exact_avg(F.when(is_most, F.col(weight)), 0), 0)
        .alias("avg_ratingcount_most_reviewed"),
        round_half_away(exact_avg(F.when(is_least, F.col(weight)), 0), 0)
        .alias("avg_ratingcount_least_reviewed"))
    lo, hi = F.col("avg_rating_least_reviewed"), F.col("avg_rating_most_reviewed")
    summary = (summary
               .withColumn("rating_bias_gap", round_half_away(lo - hi, 3))
               .withColumn("bias_interpretation", F.when(lo > hi, BIAS_POSITIVE)
                                                   .when(lo < hi, BIAS_NEGATIVE)
                                                   .otherwise(BIAS_NONE))
               .withColumn("_absgap", F.abs(lo - hi)))
    summary = materialize(summary, "q8-summary")
    ranked = rank_all(summary, [("_absgap", "desc")], "bias_rank", "dense_rank", "q8-rank",
                      store=False)
    return (ranked.select(group, "most_reviewed_company_count", "least_reviewed_company_count",
                          "avg_rating_most_reviewed", "avg_rating_least_reviewed",
                          "avg_ratingcount_most_reviewed", "avg_ratingcount_least_reviewed",
                          "rating_bias_gap", "bias_interpretation", "bias_rank")
                  .orderBy("bias_rank", F.col(group).asc_nulls_first()))


# --------------------------------------------------------------------------
# Q9: competitive intensity per group


def competitive_intensity(df: DataFrame, as_of_year: int | None = None,
                          weights=(0.35, 0.30, 0.20, 0.15), group: str = "Country",
                          zero_year_as_null: bool = False) -> DataFrame:
    base = _age_rows(df, as_of_year, ["Rating", "Employees_Count"], zero_year_as_null)
    metrics = base.groupBy(group).agg(
        F.count(F.lit(1)).alias("company_count"),
        round_half_away(exact_avg("Rating"), 3).alias("avg_rating"),
        round_half_away(exact_avg("Employees_Count", 0), 0).alias("avg_employees"),
        round_half_away(exact_avg("company_age", 0), 1).alias("avg_company_age"))
    metrics = materialize(metrics, "q9-metrics")
    cols = ["company_count", "avg_rating", "avg_employees", "avg_company_age"]
    # global min/max: one aggregate, attached as one scalar subquery
    stats = metrics.agg(*[F.min(c).alias(f"min_{c}") for c in cols],
                        *[F.max(c).alias(f"max_{c}") for c in cols])
    norm = [minmax(c, f"_g.min_{c}", f"_g.max_{c}") for c in cols]
    scored = with_scalars(metrics, stats).withColumn(
        "_raw_score", weighted(list(zip(weights, norm)))).withColumn(
        "competitive_intensity_score", round_half_away("_raw_score", 4))
    ranked = rank_all(scored, [("competitive_intensity_score", "desc"), ("avg_rating", "desc"),
                               ("company_count", "desc")], "competitive_rank", "dense_rank",
                      "q9-rank", store=False)
    return (ranked.select(group, *cols, "competitive_intensity_score", "competitive_rank")
                  .orderBy("competitive_rank", F.col(group).asc_nulls_first()))


# --------------------------------------------------------------------------
# Q10: mature underperformers


def mature_underperformers(df: DataFrame, as_of_year: int | None = None,
                           group: str = "Country",
                           zero_year_as_null: bool = False) -> DataFrame:
    base = _age_rows(df, as_of_year, ["Rating"], zero_year_as_null).select(
        "Name", group, "Rating", "company_age")
    # one read of the base: the age histogram also carries the rating sums
    hist = materialize(base.groupBy(group, "company_age").agg(
        F.count(F.lit(1)).alias("_n"), exact_sum("Rating").alias("_sum")), "q10-hist")
    means = hist.groupBy(group).agg(
        (F.sum("_sum").cast("double") / F.sum("_n")).alias("country_avg_rating"))
    stats = means.join(median_table(hist, [group], "company_age", "median_company_age",
                                    weight="_n", label="q10-median"), group)
    bench = join_stored(base, stats, [group], label="q10-bench")
    under = (bench.filter((F.col("company_age") > F.col("median_company_age"))
                          & (F.col("Rating") < F.col("country_avg_rating")))
                  .withColumn("rating_gap",
                              round_half_away(F.col("country_avg_rating") - F.col("Rating"), 3)))
    ranked = rank_within(under, [group], [("rating_gap", "desc"), ("company_age", "desc"),
                                          ("Name", "asc")], "underperformance_rank", "rank",
                         label="q10-rank")
    return (ranked.select(group, "Name", "company_age", "median_company_age", "Rating",
                          "country_avg_rating", "rating_gap",
                          F.col("underperformance_rank").cast("long"))
                  .orderBy(group, "underperformance_rank"))


# --------------------------------------------------------------------------
# Q11: young, above-benchmark employers


def emerging_employers(df: DataFrame, as_of_year: int | None = None, max_age: int = 10,
                       weights=(0.60, 0.40), k: int = 3, group: str = "Country",
                       zero_year_as_null: bool = False) -> DataFrame:
    base = _age_rows(df, as_of_year, ["Rating", "Employees_Count"], zero_year_as_null).select(
        "id", "Name", group, "Rating", "Employees_Count", "Company_year", "company_age")
    bench = group_stats(base, [group], [
        exact_avg("Rating").alias("country_avg_rating"),
        exact_avg("Employees_Count", 0).alias("country_avg_employees")], label="q11-bench")
    r, e = F.col("Rating"), F.col("Employees_Count")
    ar, ae = F.col("country_avg_rating"), F.col("country_avg_employees")
    cand = (bench.filter((F.col("company_age") <= max_age) & (r > ar) & (e > ae))
                 .withColumn("rating_lift", round_half_away(r - ar, 3))
                 .withColumn("employee_lift", round_half_away(e - ae, 0))
                 .withColumn("emerging_score", round_half_away(weighted([
                     (weights[0], nullsafe_div(r, ar)), (weights[1], nullsafe_div(e, ae))]), 4)))
    ranked = topk_within(cand, [group], [("emerging_score", "desc"), ("Rating", "desc"),
                                         ("Employees_Count", "desc"), ("Name", "asc"),
                                         ("id", "asc")], k, "emerging_rank")
    return (ranked.select(group, "Name", F.col("Company_year").alias("Company_Year"),
                          "company_age", "Rating", "country_avg_rating", "Employees_Count",
                          "country_avg_employees", "rating_lift", "employee_lift",
                          "emerging_score", F.col("emerging_rank").cast("long"))
                  .orderBy(group, "emerging_rank"))


# --------------------------------------------------------------------------
# Q12: age x size segments and how often each wins


def combined_segments(df: DataFrame, as_of_year: int | None = None,
                      group: str = "Country",
                      zero_year_as_null: bool = False) -> DataFrame:
    base = _age_rows(df, as_of_year, ["Rating", "Employees_Count"], zero_year_as_null).select(
        "Name", group, "Rating", "Employees_Count", "company_age")
    # one read of the base: both medians come from the (age, size) histogram
    hist = materialize(base.groupBy(group, "company_age", "Employees_Count").agg(
        F.count(F.lit(1)).alias("_n")), "q12-hist")
    medians = median_table(hist, [group], "company_age", "median_company_age", weight="_n",
                           label="q12-age").join(
        median_table(hist, [group], "Employees_Count", "median_employees", weight="_n",
                     label="q12-emp"), group)
    bench = join_stored(base, medians, [group], label="q12-medians")
    labeled = bench.withColumn("combined_segment", F.concat(
        F.when(F.col("company_age") <= F.col("median_company_age"), "Young").otherwise("Old"),
        F.lit(" + "),
        F.when(F.col("Employees_Count") <= F.col("median_employees"), "Small")
         .otherwise("Large")))
    seg = labeled.groupBy(group, "combined_segment").agg(
        F.count(F.lit(1)).alias("company_count"),
        round_half_away(exact_avg("Rating"), 3).alias("avg_rating"),
        round_half_away(exact_avg("company_age", 0), 1).alias("avg_age"),
        round_half_away(exact_avg("Employees_Count", 0), 0).alias("avg_employees"))
    # four segments per group at most: a bounded window partition
    ranked = seg.withColumn("segment_rank", F.dense_rank().over(
        Window.partitionBy(group).orderBy(*order_exprs([
            ("avg_rating", "desc"), ("company_count", "desc"), ("avg_employees", "desc")])))
        .cast("long"))
    ranked = materialize(ranked, "q12-ranked")
    winners = (ranked.filter(F.col("segment_rank") == 1).groupBy("combined_segment")
                     .agg(F.count(F.lit(1)).alias("countries_where_segment_is_best")))
    out = ranked.join(F.broadcast(winners), "combined_segment", "left").withColumn(
        "countries_where_segment_is_best",
        F.coalesce(F.col("countries_where_segment_is_best"), F.lit(0).cast("long")))
    return (out.select(group, "combined_segment", "company_count", "avg_rating", "avg_age",
                       "avg_employees", "segment_rank", "countries_where_segment_is_best")
               .orderBy(group, "segment_rank", "combined_segment"))


# --------------------------------------------------------------------------
# Q13: composite of three per-group ranks


def composite_rank(df: DataFrame, as_of_year: int | None = None, weights=(0.50, 0.30, 0.20),
                   top_share: float = 0.25, group: str = "Country",
                   zero_year_as_null: bool = False) -> DataFrame:
    base = _age_rows(df, as_of_year, ["Rating", "Employees_Count"], zero_year_as_null).select(
        "id", "Name", group, "Rating", "Employees_Count", "company_age")
    # rows without a group have no group size and no score
    r = ranks_within(base.where(F.col(group).isNotNull()), [group],
                     [([("Rating", "desc")], "rating_rank", "rank"),
                      ([("Employees_Count", "desc")], "employee_rank", "rank"),
                      ([("company_age", "desc")], "age_rank", "rank")],
                     "q13-ranks", store=False, total="country_company_count")
    n = F.col("country_company_count")
    ranks = ["rating_rank", "employee_rank", "age_rank"]
    score = weighted([(w, rank_score(rk, n)) for w, rk in zip(weights, ranks)])
    cap = F.ceil(n * top_share)
    balanced = (F.col(ranks[0]) <= cap) & (F.col(ranks[1]) <= cap) & (F.col(ranks[2]) <= cap)
    scored = (r.withColumn("composite_score", round_half_away(score, 4))
               .withColumn("profile_type", F.when(balanced, BALANCED).otherwise(MIXED)))
    final = row_positions(scored, [group],
                          [("composite_score", "desc"), ("rating_rank", "asc"),
                           ("employee_rank", "asc"), ("age_rank", "asc"), ("Name", "asc"),
                           ("id", "asc")], "composite_rank", "_cn", label="q13-final")
    return (final.select(group, "Name", "Rating", "Employees_Count", "company_age",
                         *[F.col(c).cast("long").alias(c) for c in ranks], "composite_score",
                         "profile_type", F.col("composite_rank").cast("long"))
                 .orderBy(group, "composite_rank"))


# --------------------------------------------------------------------------
# Q14: headquarters concentration per group


def concentration(df: DataFrame, group: str = "Country", member: str = "Headquarters") -> DataFrame:
    base = _not_null(df, [group, member, "Rating", "Employees_Count"])
    # two-level aggregation: (group, member) partials, then group totals; no join
    per_member = base.groupBy(group, member).agg(
        F.count(F.lit(1)).alias("c"),
        exact_sum("Rating").alias("rs"), exact_sum("Employees_Count", 0).alias("es"))
    n, c = F.sum("c"), F.col("c").cast("decimal(18,0)")
    wide = n.cast("double")
    per_group = per_member.groupBy(group).agg(
        n.alias("company_count"),
        F.count(F.lit(1)).alias("unique_headquarters"),
        round_half_away(F.sum(c * c).cast("double") / (wide * wide), 4)
        .alias("hhi_concentration_index"),
        round_half_away(F.max("c") / n, 4).alias("largest_hq_share"),
        round_half_away(F.sum("rs").cast("double") / n, 3).alias("avg_rating"),
        round_half_away(F.sum("es").cast("double") / n, 0).alias("avg_employees"))
    per_group = materialize(per_group, "q14-groups")
    r = ranks_within(per_group, [], [
        ([("hhi_concentration_index", "desc")], "concentration_rank", "dense_rank"),
        ([("avg_rating", "desc")], "rating_rank", "dense_rank"),
        ([("avg_employees", "desc")], "size_rank", "dense_rank")], "q14-ranks", store=False)
    return (r.select(group, "company_count", "unique_headquarters", "hhi_concentration_index",
                     "largest_hq_share", "avg_rating", "avg_employees", "concentration_rank",
                     "rating_rank", "size_rank")
             .orderBy("concentration_rank", group))
