"""Table functions over pages, for SQL.

``register(spark)`` adds, for ``LATERAL`` use:

* ``page_cards(html)``: the company cards of a listing page;
* ``page_elements(html, selector)``: position and text of the elements that a selector
  names: ``tag``, ``.class`` or ``tag.class``.

Both are Python table functions with Arrow transfer: the arguments of many rows cross to
Python in one batch, and so do the results.  (Functions that take whole Arrow batches
themselves cannot be called laterally.)  They add nothing to what
:mod:`scorekit.sources.html` finds; NULL pages and NULL or empty selectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import html as H

CARDS = "pos int, name string, rating string, rating_count string, link string"
ELEMENTS = "pos int, text string"


class PageCards:
    """The cards of a listing page."""

    def eval(self, html: str) -> Iterator[tuple]:
        from ..plans.extraction import card_fields
        yield from card_fields(html) if html else ()


class PageElements:
    """Elements of a page by ``tag``, ``.class`` or ``tag.class``."""

    def eval(self, html: str, selector: str) -> Iterator[tuple]:
        tag, _, class_ = (selector or "").partition(".")
        if html and (tag or class_):
            wanted = ({"tag": tag} if tag else {}) | ({"class_": class_} if class_ else {})
            for i, element in enumerate(H.find_all(H.parse(html), **wanted)):
                yield i, element.text()


def register(spark: SparkSession) -> None:
    """Make the table functions known to ``spark.sql``."""
    ship_package(spark)
    spark.udtf.register("page_cards", F.udtf(PageCards, returnType=CARDS, useArrow=True))
    spark.udtf.register("page_elements", F.udtf(PageElements, returnType=ELEMENTS, useArrow=True))


def cards_by_sql(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Listing pages ``(page_id, html)`` -> one row per company card, in SQL."""
    register(spark)
    return spark.sql("""SELECT p.page_id, c.pos, c.name, c.rating, c.rating_count, c.link
                        FROM {pages} AS p, LATERAL page_cards(p.html) AS c""", pages=pages)


def elements_by_sql(spark: SparkSession, pages: DataFrame, selector: str) -> DataFrame:
    """Pages ``(page_id, html)`` -> position and text of the selected elements, in SQL."""
    register(spark)
    return spark.sql("""SELECT p.page_id, e.pos, e.text
                        FROM {pages} AS p, LATERAL page_elements(p.html, :selector) AS e""",
                     args={"selector": selector}, pages=pages)
