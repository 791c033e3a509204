"""Listing and detail pages rendered from the scraped fields (a page source).

Listing page ``p`` holds the company cards of keys ``20p .. 20p+19``; every
card with a link has a detail page.  Markup varies with the key so that the
extraction job meets every case it handles: padded and entity-encoded names,
nested rating text, missing tags and links, label values in the next or the
previous sibling, an empty next sibling, and a value held in a following link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import stored

PAGE_SIZE = 20
LISTING_URL = "https://listing.example/companies?page="
DETAIL_URL = "https://listing.example/overview/"


def _opt(cond: Column, html: Column) -> Column:
    return F.when(cond, html).otherwise(F.lit(""))


def _card(k: Column) -> Column:
    name, rating, rc = F.col("Name"), F.col("Rating"), F.col("Rating Count")
    name_html = _opt(name.isNotNull(), F.concat(
        F.lit('<h2 class="companyCardWrapper__companyName">'),
        _opt(k % 11 == 0, F.lit(" \n  ")), name, _opt(k % 17 == 0, F.lit(" &amp; Sons")),
        _opt(k % 11 == 0, F.lit("\t ")), F.lit("</h2>")))
    rating_html = (F.when(rating.isNull(), F.lit(""))
                    .when(k % 13 == 0, F.concat(F.lit('<div class="rating_text"><span>'), rating,
                                                F.lit("</span></div>")))
                    .otherwise(F.concat(F.lit('<div class="rating_text"> '), rating,
                                        F.lit(" </div>"))))
    count_html = _opt(rc.isNotNull(), F.concat(
        F.lit('<span class="companyCardWrapper__companyRatingCount">('), rc, F.lit(")</span>")))
    meta_html = _opt(k % 19 != 0, F.concat(F.lit('<meta itemprop="url" content="'),
                                           F.lit(DETAIL_URL), k.cast("string"), F.lit('">')))
    return F.concat(F.lit('<div class="companyCardWrapper">'), name_html,
                    F.lit('<div class="card_meta">'), rating_html, count_html, F.lit("</div>"),
                    meta_html, F.lit("</div>"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html)``: one listing page per 20 keys (a bounded group)."""
    f = stored(spark, sf_dir, "scraped_fields")
    k = F.col("pos")
    cards = f.select(F.floor(k / PAGE_SIZE).alias("page_id"), k.alias("k"), _card(k).alias("card"))
    pages = cards.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "card"))).alias("cards"))
    return pages.select(
        F.col("page_id").cast("long"),
        F.concat(F.lit(LISTING_URL), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit("<!DOCTYPE html><html><head><title>Companies</title></head><body>"
                       "<h1>List of companies</h1><div class=\"list\">"),
                 F.array_join(F.transform("cards", lambda c: c["card"]), ""),
                 F.lit("</div></body></html>")).alias("html"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, html)``: one overview page per card that has a link.

    The fields come from a table of few files; they are hash-spread before
    rendering so that the CPU-heavy page parsing downstream runs in parallel
    (the fields are smaller than the pages; AQE sizes the partitions)."""
    f = (stored(spark, sf_dir, "scraped_fields").filter(F.col("pos") % 19 != 0)
         .repartition("pos"))  # no fixed count: AQE sizes the partitions
    k = F.col("pos")
    year = F.coalesce(F.col("Company_year"), F.lit("not disclosed"))
    founded = (F.when(k % 4 == 0, F.concat(
                    F.lit('<div class="block"><div class="label">Founded</div>'
                          '<div class="value">Est. '), year, F.lit("</div></div>")))
                .when(k % 4 == 1, F.concat(
                    F.lit('<div class="block"><div class="value">'), year,
                    F.lit('</div><div class="label">Founded in</div></div>')))
                .when(k % 4 == 2, F.concat(
                    F.lit('<div class="block"><div class="value">since '), year,
                    F.lit('</div><div class="label">Founded</div><div class="value"></div></div>')))
                .otherwise(F.lit("")))
    hq = F.col("Headquarters")
    hq_html = (F.when(hq.isNull(), F.lit(""))
                .when(k % 3 == 0, F.concat(
                    F.lit('<div class="block"><div class="label">Headquarters</div>'
                          '<div class="value"> '), hq, F.lit(" </div></div>")))
                .when(k % 3 == 1, F.concat(
                    F.lit('<div class="block"><div class="label">Headquarters</div>'
                          '<span>map</span></div><p><a href="/locations/'), k.cast("string"),
                    F.lit('"> '), hq, F.lit(" </a></p>")))
                .otherwise(F.lit("")))
    emp = F.col("Employees Count")
    label = F.when(k % 2 == 0, F.lit("Employee Count")).otherwise(F.lit("Company Size"))
    emp_html = (F.when(emp.isNull(), F.lit(""))
                 .when(k % 5 < 3, F.concat(
                     F.lit('<div class="block"><div class="label">'), label,
                     F.lit('</div><div class="value">'), emp, F.lit("</div></div>")))
                 .when(k % 5 == 3, F.concat(
                     F.lit('<div class="block"><div class="value">'), emp,
                     F.lit('</div><div class="label">'), label,
                     F.lit('</div><div class="value"></div></div>')))
                 .otherwise(F.concat(
                     F.lit('<div class="block"><div class="value">'), emp,
                     F.lit('</div><div class="label">'), label, F.lit("</div></div>"))))
    return f.select(
        F.concat(F.lit(DETAIL_URL), k.cast("string")).alias("url"),
        F.concat(F.lit("<html><body><h1>Overview</h1><section>"), founded, hq_html, emp_html,
                 F.lit("</section></body></html>")).alias("html"))
