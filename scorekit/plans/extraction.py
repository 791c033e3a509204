"""Extraction jobs over HTML pages.

Selectors that one regular expression answers exactly (first ``h1``, ``a``
links, ``meta charset``) run on the JVM.  Structural selectors (cards by
class, label -> sibling value) parse each page once with
:mod:`scorekit.sources.html` inside ``mapInPandas``: Spark partitions the
pages, each task parses its own documents, rows leave as Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import employee_count
from ..session import ship_package
from ..sources import html as H

CARD_SCHEMA = ("page_id long, pos int, name string, rating string, rating_count string, "
               "link string")
DETAIL_SCHEMA = "url string, founded_year string, headquarters string, employees_text string"

# Where each field stands on the scraped pages.
CARD_CLASS = "companyCardWrapper"
#: Card fields: element, and the attribute to read (None: its text) less some characters.
CARD_FIELDS = {
    "name": ({"tag": "h2"}, None, ""),
    "rating": ({"tag": "div", "class_": "rating_text"}, None, ""),
    "rating_count": ({"tag": "span", "class_": "companyCardWrapper__companyRatingCount"}, None, "()"),
    "link": ({"tag": "meta", "attrs": {"itemprop": "url"}}, "content", ""),
}
#: Overview fields: words of the label, where its value stands (tried in turn) and the
#: pattern to take from it (None: all of it).
DETAIL_FIELDS = {
    "founded_year": (("Founded",), ("next div", "previous div"), r"\d{4}"),
    "headquarters": (("Headquarters",), ("next div or any", "following a"), r"\S(?:.*\S)?"),
    "employees_text": (("Employee Count", "Company Size"), ("next div", "previous div", "empty"),
                       None),
}


def _value_at(label: H.Node, place: str) -> str | None:
    """The text that a place gives; None sends the search to the next place."""
    if place == "empty":
        return ""
    way, tag = place.split()[:2]
    node = {"next": label.next_sibling_tag, "previous": label.previous_sibling_tag,
            "following": label.next_in_document}[way](tag)
    if node is None:
        return None
    return node.text() if place.endswith("any") else node.text() or None


def card_fields(html: str) -> list[tuple]:
    """Cards of one listing page: position, then ``CARD_FIELDS`` in order."""
    def read(card, where, attribute, without):
        node = H.find(card, **where)
        if node is None:
            return None
        value = node.attrs.get(attribute) if attribute else node.text().strip()
        return value and value.translate(dict.fromkeys(map(ord, without)))

    cards = H.find_all(H.parse(html), class_=CARD_CLASS)
    return [(i, *(read(card, *f) for f in CARD_FIELDS.values())) for i, card in enumerate(cards)]


def detail_fields(html: str) -> tuple:
    """``DETAIL_FIELDS`` of one overview page, in order; None where one is missing."""
    root = H.parse(html)

    def read(words, places, pattern):
        label = H.find(root, tag="div", string=lambda s: any(w in s for w in words))
        values = (_value_at(label, p) for p in places) if label is not None else ()
        text = next((v for v in values if v is not None), None)
        if text is None or pattern is None:
            return text
        found = re.search(pattern, text, re.S)
        return found.group() if found else ("" if pattern.startswith(r"\S") else None)

    return tuple(read(*f) for f in DETAIL_FIELDS.values())


def _cards_udf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(pid, *c) for pid, html in zip(pdf["page_id"], pdf["html"])
                for c in card_fields(html)]
        yield pd.DataFrame(rows, columns=["page_id", "pos", *CARD_FIELDS])


def _details_udf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(url, *detail_fields(html)) for url, html in zip(pdf["url"], pdf["html"])]
        yield pd.DataFrame(rows, columns=["url", *DETAIL_FIELDS])


def _class_text_udf(class_name: str, out_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pid, html in zip(pdf["page_id"], pdf["html"]):
                for i, el in enumerate(H.find_all(H.parse(html), class_=class_name)):
                    rows.append((pid, i, el.text()))
            yield pd.DataFrame(rows, columns=["page_id", "pos", out_col])
    return run


def extract_cards(listing: DataFrame) -> DataFrame:
    """Listing pages ``(page_id, html)`` -> one row per company card."""
    ship_package(listing.sparkSession)
    return listing.select("page_id", "html").mapInPandas(_cards_udf, CARD_SCHEMA)


def extract_details(detail: DataFrame) -> DataFrame:
    """Overview pages ``(url, html)`` -> founded year, HQ and employee text per URL."""
    ship_package(detail.sparkSession)
    return detail.select("url", "html").mapInPandas(_details_udf, DETAIL_SCHEMA)


def enrich_cards(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Cards left-joined to their overview fields; employees cleaned natively.

    A card without a link (or without a page) keeps NULL details."""
    d = details.withColumn("employees", employee_count("employees_text"))
    return (cards.join(d, cards.link == d.url, "left")
                 .select("page_id", "pos", "name", "rating", "rating_count", "link",
                         "founded_year", "headquarters", "employees"))


def extract_class_text(pages: DataFrame, class_name: str = "ad",
                       out_col: str = "ad_text") -> DataFrame:
    """Text of every element carrying ``class_name``, per page, in document order."""
    schema = f"page_id long, pos int, {out_col} string"
    ship_package(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(_class_text_udf(class_name, out_col),
                                                       schema)


# ----------------------------------------------------------------- JVM regex

# Named character references that pages use beside the numeric ones.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9",
         "reg": "\u00ae", "trade": "\u2122", "hellip": "\u2026", "ndash": "\u2013",
         "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c",
         "rdquo": "\u201d", "bull": "\u2022", "middot": "\u00b7", "euro": "\u20ac",
         "pound": "\u00a3", "amp": "&"}
#: A decimal or hexadecimal reference; leading zeros do not count.
_NUMERIC = "(?i)&#(x[0-9a-f]+|[0-9]+);"
#: What a reference to no character (0, a surrogate, beyond the last code point) stands for.
REPLACEMENT = 0xFFFD
LAST_CODE_POINT = 0x10FFFF


def decode_entities(c: Column) -> Column:
    """Decode numeric character references and the named ones of ``NAMED``
    (``&amp;`` last).  A number that is no character gives U+FFFD."""
    parts = F.split(c, _NUMERIC, -1)
    found = F.regexp_extract_all(c, F.lit(_NUMERIC), F.lit(1))

    def char(r: Column) -> Column:
        digits = F.regexp_replace(r, "^[xX]?0*", "")
        code = (F.when(F.length(digits) > 7, REPLACEMENT)
                 .when(F.lower(F.substring(r, 1, 1)) == "x", F.conv(digits, 16, 10).try_cast("int"))
                 .otherwise(digits.try_cast("int")))
        no_char = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (
            code > LAST_CODE_POINT)
        four = F.lpad(F.hex(F.when(no_char, REPLACEMENT).otherwise(code)), 8, "0")
        return F.decode(F.unhex(four), "UTF-32")  # big-endian

    numeric = F.array_join(F.zip_with(parts, F.transform(found, char),
                                      lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    c = F.when(c.contains("&#"), numeric).otherwise(c)
    for name, ch in NAMED.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    return c


def markup(html: Column) -> Column:
    """The page without comments and without the text of scripts and styles, in which
    nothing is a tag.  What is left open reaches to the end of the page."""
    return F.regexp_replace(
        html, r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|(<(script|style)\b[^>]*>).*?(?:</\2\s*>|\z)", "$1")


def attribute_values(html: Column, tag: str, attribute: str) -> Column:
    """Values of an attribute of every ``<tag>``: names in any case, quoted or not, set off
    by white space or a slash."""
    value = r"""(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+)"""
    other = rf"""(?:[\s/]+[^\s"'<>/=]+(?:\s*=\s*{value})?)*?"""
    raw = F.regexp_extract_all(
        markup(html), F.lit(rf"(?is)<{tag}{other}[\s/]+{attribute}\s*=\s*({value})"), F.lit(1))
    return F.transform(raw, lambda v: decode_entities(
        F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2")))


def tag_texts(html: Column, tag: str) -> Column:
    """Inner text of every ``<tag>`` element (inner tags removed, entities decoded)."""
    inner = F.regexp_extract_all(markup(html), F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>"), F.lit(1))
    return F.transform(inner, lambda s: decode_entities(F.regexp_replace(s, "<[^>]*>", "")))


def all_tag_texts(pages: DataFrame, tag: str, out_col: str = "text") -> DataFrame:
    """Every ``<tag>`` text of every page, stripped, with its position on the page."""
    from ..functions.text import strip_ws
    return (pages.select("page_id", F.posexplode(tag_texts(F.col("html"), tag)))
                 .select("page_id", F.col("pos").cast("int").alias("pos"),
                         strip_ws(F.col("col")).alias(out_col)))


def page_headings(pages: DataFrame) -> DataFrame:
    """First ``h1`` text of each page (NULL when the page has none)."""
    return pages.select("page_id", F.try_element_at(tag_texts(F.col("html"), "h1"), F.lit(1))
                        .alias("heading"))


def page_links(pages: DataFrame) -> DataFrame:
    """Every ``a[href]`` value, one row per link occurrence."""
    hrefs = attribute_values(F.col("html"), "a", "href")
    return pages.select("page_id", F.explode(hrefs).alias("href"))


def distinct_links(pages: DataFrame) -> DataFrame:
    return page_links(pages).select("href").distinct()


def link_counts(pages: DataFrame) -> DataFrame:
    """Total and unique link counts (one row)."""
    return page_links(pages).agg(F.count(F.lit(1)).alias("total_links"),
                                 F.countDistinct("href").alias("unique_links"))


def page_charset(pages: DataFrame) -> DataFrame:
    found = attribute_values(F.col("html"), "meta", "charset")
    return pages.select("page_id", F.try_element_at(found, F.lit(1)).alias("charset"))


def page_preview(pages: DataFrame, n: int = 2000) -> DataFrame:
    return pages.select("page_id", F.substring("html", 1, n).alias("preview"))
