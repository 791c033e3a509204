"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact_avg
from ..functions.text import country_of, employee_count, suffixed_count
from ..operators import group_median, skew_join
from ..operators import sketches as S
from ..session import materialize, scratch_dir
from ..sources import card_pages as P
from ..sources import catalog, files, frontier, page_tables, rejects
from ..sources.bindings import stored
from ..sources.merge_table import scratch_table
from ..sources.tables import read_table
from . import analyses as A
from . import cleaning as C
from . import extraction as X
from . import quality as Q
from .oracle_sql import AS_OF_YEAR  # the year both sides pin YEAR(CURDATE()) to

Query = Callable[[SparkSession, str], DataFrame]


def _on_companies(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(stored(spark, sf_dir, "companies"), **kw)
    run.__name__ = fn.__name__
    return run


def _group_median(df):
    return group_median(df, ["Country"], "RatingCount", "median_ratingcount")


ANALYSIS_QUERIES: dict[str, Query] = {
    "group_median": _on_companies(_group_median),
    "top_rated": _on_companies(A.top_rated),
    "top_rated_min_reviews": _on_companies(A.top_rated, min_reviews=10000, k=5),
    "low_review_high_rating": _on_companies(A.low_review_bias),
    "country_size_rating": _on_companies(A.size_distribution),
    "credibility_rank": _on_companies(A.credibility_rank),
    "hidden_popular_leaders": _on_companies(A.leader_classes),
    "age_segment_strength": _on_companies(A.age_segments, as_of_year=AS_OF_YEAR),
    "size_overperformers": _on_companies(A.overperformers),
    "review_volume_bias": _on_companies(A.review_bias),
    "competitive_intensity": _on_companies(A.competitive_intensity, as_of_year=AS_OF_YEAR),
    "mature_underperformers": _on_companies(A.mature_underperformers, as_of_year=AS_OF_YEAR),
    "emerging_employers": _on_companies(A.emerging_employers, as_of_year=AS_OF_YEAR),
    "combined_segments": _on_companies(A.combined_segments, as_of_year=AS_OF_YEAR),
    "composite_rank": _on_companies(A.composite_rank, as_of_year=AS_OF_YEAR),
    "hq_concentration": _on_companies(A.concentration),
}


def _on_orders(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(stored(spark, sf_dir, "entities_orders"), **kw)
    run.__name__ = fn.__name__ + "_orders"
    return run


ORDERS_QUERIES: dict[str, Query] = {
    "credibility_rank_orders": _on_orders(A.credibility_rank),
    "hidden_popular_leaders_orders": _on_orders(A.leader_classes),
    "size_overperformers_orders": _on_orders(A.overperformers),
    "review_volume_bias_orders": _on_orders(A.review_bias),
    "mature_underperformers_orders": _on_orders(A.mature_underperformers, as_of_year=AS_OF_YEAR),
    "composite_rank_orders": _on_orders(A.composite_rank, as_of_year=AS_OF_YEAR),
    "hq_concentration_orders": _on_orders(A.concentration),
}


def _on_fine(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(stored(spark, sf_dir, "companies_fine"), **kw)
    run.__name__ = fn.__name__ + "_fine"
    return run


FINE_QUERIES: dict[str, Query] = {
    "country_size_rating_fine": _on_fine(A.size_distribution),
    "credibility_rank_fine": _on_fine(A.credibility_rank),
    "age_segment_strength_fine": _on_fine(A.age_segments, as_of_year=AS_OF_YEAR),
    "competitive_intensity_fine": _on_fine(A.competitive_intensity, as_of_year=AS_OF_YEAR),
    "mature_underperformers_fine": _on_fine(A.mature_underperformers, as_of_year=AS_OF_YEAR),
    "hq_concentration_fine": _on_fine(A.concentration),
}


def _credibility_rank_ci(df: DataFrame) -> DataFrame:
    """Country names in mixed case, ranked as a case-insensitive collation groups them."""
    mixed = F.when((F.col("id") - 1) % 2 == 0, F.lower("Country")).otherwise(F.col("Country"))
    ranked = A.credibility_rank(A.case_insensitive(df.withColumn("Country", mixed)))
    return ranked.withColumn("Country", F.col("Country").cast("string"))


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table written as CSV, twice over, and read with its schema."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = stored(spark, sf_dir, "companies")
    files.write_clean(rows.limit(0), path, "csv")
    files.append_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


def _catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table inserted into a typed catalog table whose text lengths are checked."""
    before = spark.catalog.currentDatabase()
    name = f"ratings_{uuid.uuid4().hex}"
    try:
        catalog.use_database(spark, "scorekit_tables", f"{scratch_dir(spark)}/tables")
        catalog.create_companies_table(spark, name)
        catalog.load_companies(stored(spark, sf_dir, "companies"), name)
        return spark.table(f"scorekit_tables.{name}")
    finally:
        spark.catalog.setCurrentDatabase(before)


def _skewed_benchmark(df: DataFrame) -> DataFrame:
    """Ratings against the benchmark of their (Country, segment), half the rows of a
    country in one segment: how many are above it."""
    rows = materialize(df.select(
        "Country", F.when(F.col("id") % 2 == 0, "all").otherwise(F.col("Headquarters"))
        .alias("Segment"), "Rating"), "segments")
    keys = ["Country", "Segment"]
    bench = rows.groupBy(*keys).agg(exact_avg("Rating").alias("segment_avg_rating"))
    rated = skew_join(rows, bench, keys)
    return rated.groupBy(*keys).agg(
        F.max("segment_avg_rating").alias("segment_avg_rating"),
        F.count(F.when(F.col("Rating") > F.col("segment_avg_rating"), 1)).alias("n_above"),
        F.count(F.lit(1)).alias("n"))


def _median_sketch(df: DataFrame) -> DataFrame:
    """Sketches stored per country and year, merged per country, beside the exact median."""
    rows = df.where(F.col("Employees_Count").isNotNull())
    group, batch, col = ["Country"], "Company_year", "Employees_Count"
    sketches = materialize(S.quantile_sketches(rows, [*group, batch], col), "sketches")
    near = S.median_within_bound(rows, group, batch, col, sketches)
    exact = group_median(rows, group, col, "median")
    return near.join(exact.select(F.col("Country").alias("_c"), "median"),
                     F.col("Country").eqNullSafe(F.col("_c"))).drop("_c")


def _distinct_sketch(df: DataFrame) -> DataFrame:
    """Names per country over both crawl batches, from sketches stored per batch."""
    rows = df.withColumn("Country", country_of("Headquarters"))
    sketches = materialize(S.distinct_sketches(rows, ["Country", "batch"], "Name"), "sketches")
    exact = rows.groupBy("Country").agg(F.countDistinct("Name").alias("names"))
    about = S.merge_distinct(sketches, ["Country"], "about").withColumnRenamed("Country", "_c")
    return exact.join(about, F.col("Country").eqNullSafe(F.col("_c"))).select(
        "Country", "names",
        (F.abs(F.col("about") - F.col("names")) <= 0.03 * F.col("names")).alias("within_3_percent"))


TABLE_QUERIES: dict[str, Query] = {
    "top_rated_by_size": _on_companies(A.top_rated, by=(("Rating", "desc"),
                                                        ("Employees_Count", "desc"))),
    "skewed_benchmark": _on_orders(_skewed_benchmark),
    "median_sketch": _on_orders(_median_sketch),
    "country_filter": _on_companies(A.in_group, value="NATION_7"),
    "first_rows": _on_companies(A.first_rows, k=5),
    "age_segment_strength_today": _on_companies(A.age_segments),
    "credibility_rank_ci": _on_companies(_credibility_rank_ci),
    "csv_round_trip": _csv_round_trip,
    "catalog_round_trip": _catalog_round_trip,
}

# Earlier names of analyses that used to have a second, distributed plan; every
# analysis now has that plan alone.
SAME_PLAN = ("group_median", "hidden_popular_leaders", "size_overperformers",
             "review_volume_bias", "competitive_intensity", "mature_underperformers",
             "combined_segments", "composite_rank", "hq_concentration")


def _on_raw(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(stored(spark, sf_dir, "companies_raw"))
    run.__name__ = fn.__name__
    return run


def _clean_employees(raw):
    return raw.select("batch", "pos", F.col("Employees Count").alias("employees_text"),
                      employee_count("Employees Count").alias("employees"))


def _clean_rating_count(raw):
    return raw.select("batch", "pos", F.col("Rating Count").alias("rating_count_text"),
                      suffixed_count("Rating Count").alias("RatingCount"))


def _extract_country(raw):
    return raw.select("batch", "pos", "Headquarters", country_of("Headquarters").alias("Country"))


def _impute_median(raw):
    return C.impute_median(C.parse_fields(raw)).select(
        "batch", "pos", F.col("Employees Count").alias("employees"))


def _impute_constants(raw):
    return C.impute_constants(C.parse_fields(raw)).select(
        "batch", "pos", "Headquarters", "Country", "Company_year")


def _merge_dedup(raw):
    return C.clean_companies(raw, keep_order_columns=True).select(
        "batch", "pos", "Name", "Headquarters")


def _load_companies(raw):
    return C.to_companies(C.clean_companies(raw, keep_order_columns=True))


def _null_profile(raw):
    return Q.null_profile(raw, ["Name", "Rating", "Rating Count", "Headquarters",
                                "Company_year", "Employees Count"])


def _column_profile(raw):
    """One pass over all columns; the estimates beside exact counts, as flags.  The summary's
    top count holds while it tracks every value of a column, else the exact one."""
    cols = ["Name", "Rating", "Rating Count", "Headquarters", "Company_year", "Employees Count"]
    found = Q.column_profile(raw, cols, limits={"Name": 18, "Headquarters": 30})
    exact = Q.value_report(raw, cols).withColumnRenamed("column_name", "_column")
    distinct = F.coalesce("distinct_count", F.lit(0))
    return found.join(exact, F.col("column_name") == F.col("_column"), "left").select(
        "column_name", "row_count", "null_count", "min_length", "max_length", "over_limit",
        distinct.alias("distinct_count"),
        (F.abs(F.col("distinct_estimate") - distinct) <= 0.03 * distinct)
        .alias("estimate_within_3_percent"),
        F.when(distinct <= Q.TRACKED, F.get("top_values", F.lit(0))["count"])
         .otherwise(F.col("top_count")).alias("top_count"))


def _table_report(raw):
    return Q.table_report(raw, ["pos"], {"Name": 18, "Headquarters": 30})


def _incremental_merge(raw):
    """The cleaned batches merged one after the other into a bucketed table."""
    rows = C.impute_constants(C.parse_fields(raw)).withColumn(
        "Rating", F.col("Rating").try_cast("double")).dropna(subset=["Name", "Rating"])
    rows = rows.select("batch", "pos", "Name", "Headquarters")
    spark = raw.sparkSession
    table = scratch_table(spark, scratch_dir(spark), ["Name", "Headquarters"], ["batch", "pos"], 32)
    for batch in (2, 1):  # the later crawl arrives first
        table.merge(rows.where(F.col("batch") == batch))
    return table.read()


def _tolerant_load(raw):
    """The scraped rows as CSV lines, some of them damaged, loaded with their rejects."""
    pos = F.col("pos")
    damaged = raw.withColumns({
        "Rating Count": F.when(pos % 29 == 1, F.lit("many")).otherwise(F.col("Rating Count")),
        "Rating": F.when(pos % 37 == 3, F.lit("good")).otherwise(F.col("Rating")),
        "Headquarters": F.when(pos % 31 == 2, F.repeat(F.lit("Long Road "), 30))
                         .otherwise(F.col("Headquarters"))})
    line = F.to_csv(F.struct(*raw.columns))
    line = (F.when(pos % 23 == 0, F.concat(line, F.lit(",one,more")))
             .when(pos % 41 == 5, F.concat_ws(",", "batch", "pos")).otherwise(line))
    path = f"{scratch_dir(raw.sparkSession)}/lines-{uuid.uuid4().hex}"
    damaged.select(line.alias("value")).write.text(path)
    accepted, refused = rejects.load_csv(raw.sparkSession, path, header=False)
    return accepted.select("batch", "pos", F.lit("accepted").alias("outcome")).unionByName(
        refused.select("batch", "pos", F.col(rejects.REASON).alias("outcome")))


def _point_corrections(raw):
    return C.apply_point_corrections(raw).select("batch", "pos", "row_index", "Headquarters")


def _streaming_ingest(raw):
    from ..streaming.batch_ingest import ingest_batches
    return ingest_batches(raw)


def _on_loaded(fn, **kw) -> Query:
    """An analysis over the cleaned rows loaded into the companies layout (stored once)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(stored(spark, sf_dir, "companies_clean"), **kw)
    run.__name__ = fn.__name__ + "_clean"
    return run


CLEANING_QUERIES: dict[str, Query] = {
    "credibility_rank_clean": _on_loaded(A.credibility_rank),
    "composite_rank_clean": _on_loaded(A.composite_rank, as_of_year=AS_OF_YEAR),
    "hq_concentration_clean": _on_loaded(A.concentration),
    "streaming_ingest": _on_raw(_streaming_ingest),
    "clean_employees": _on_raw(_clean_employees),
    "clean_rating_count": _on_raw(_clean_rating_count),
    "extract_country": _on_raw(_extract_country),
    "impute_median": _on_raw(_impute_median),
    "impute_constants": _on_raw(_impute_constants),
    "merge_dedup_batches": _on_raw(_merge_dedup),
    "clean_companies": _on_raw(C.clean_companies),
    "load_companies": _on_raw(_load_companies),
    "null_profile": _on_raw(_null_profile),
    "point_corrections": _on_raw(_point_corrections),
    "distinct_sketch": _on_raw(_distinct_sketch),
    "column_profile": _on_raw(_column_profile),
    "table_report": _on_raw(_table_report),
    "incremental_merge": _on_raw(_incremental_merge),
    "tolerant_load": _on_raw(_tolerant_load),
}


def _pages(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(read_table(spark, sf_dir, "pages"))
    run.__name__ = fn.__name__
    return run


def _cards_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_cards(P.listing_pages(spark, sf_dir))


def _detail_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = X.extract_cards(P.listing_pages(spark, sf_dir))
    return X.enrich_cards(cards, X.extract_details(P.detail_pages(spark, sf_dir)))


def _listing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.all_tag_texts(P.listing_pages(spark, sf_dir), "h2", "name")


def _url_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = (F.floor(F.col("pos") / P.PAGE_SIZE) + 1).cast("long")
    return (stored(spark, sf_dir, "scraped_fields").select(page.alias("page")).distinct()
            .select("page", F.concat(F.lit(P.LISTING_URL), F.col("page").cast("string"))
                    .alias("url")))


#: First page of the crawl that the frontier queries look at.
FRONTIER_START = 101


def _crawl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """A log of fetched page ranges, one per order, and the last page wanted."""
    key = F.col("o_orderkey").cast("long")
    first = F.col("o_custkey").cast("long") * 5 + key % 4
    log = read_table(spark, sf_dir, "orders").select(
        first.alias("first"),
        F.when(key % 31 == 0, first - 2).when(key % 37 != 0, first + key % 3).alias("last"))
    return log, log.agg(F.max("last")).first()[0] + 50


def _page_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, stop = _crawl(spark, sf_dir)
    missing = frontier.missing_ranges(log, FRONTIER_START, stop)
    twice = frontier.repeated_ranges(log, FRONTIER_START, stop)
    return missing.select(F.lit("missing").alias("state"), "first", "last").unionByName(
        twice.select(F.lit("repeated").alias("state"), "first", "last"))


def _frontier_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages still to fetch."""
    log, stop = _crawl(spark, sf_dir)
    return frontier.page_urls(frontier.missing_ranges(log, FRONTIER_START, stop), P.LISTING_URL)


def _cards_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tables.cards_by_sql(spark, P.listing_pages(spark, sf_dir))


def _elements_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return page_tables.elements_by_sql(spark, pages, "div.ad").withColumnRenamed("text", "ad_text")


EXTRACTION_QUERIES: dict[str, Query] = {
    "page_frontier": _page_frontier,
    "frontier_urls": _frontier_urls,
    "cards_by_sql": _cards_by_sql,
    "elements_by_sql": _elements_by_sql,
    "cards_extract": _cards_extract,
    "detail_enrich": _detail_enrich,
    "url_frontier": _url_frontier,
    "listing_names": _listing_names,
    "page_ads": _pages(X.extract_class_text),
    "page_headings": _pages(X.page_headings),
    "page_links": _pages(X.page_links),
    "distinct_links": _pages(X.distinct_links),
    "link_counts": _pages(X.link_counts),
    "page_charset": _pages(X.page_charset),
    "page_preview": _pages(X.page_preview),
}


def all_queries() -> dict[str, Query]:
    same = {f"{n}_distributed": ANALYSIS_QUERIES[n] for n in SAME_PLAN}
    return {**ANALYSIS_QUERIES, **same, **FINE_QUERIES, **TABLE_QUERIES, **ORDERS_QUERIES,
            **CLEANING_QUERIES, **EXTRACTION_QUERIES}


def all_oracles() -> dict[str, str]:
    from .oracle_cleaning import CLEANING
    from .oracle_sql import ANALYSES
    from .oracle_extraction import EXTRACTION
    same = {f"{n}_distributed": ANALYSES[n] for n in SAME_PLAN}
    return {**ANALYSES, **same, **CLEANING, **EXTRACTION}
