"""DuckDB formulations of the extraction queries.

Card and overview pages are rendered from the scraped fields, so the oracle
states the expected extraction directly from those fields; page queries use
RE2 regular expressions over ``pages``.
"""

from __future__ import annotations

from .oracle_cleaning import EMP, RAW

FIELDS = RAW + """, keyed AS (
    SELECT pos AS k, Name, Rating, "Rating Count", Headquarters, Company_year,
           "Employees Count" FROM raw_fields
), expected_cards AS (
    SELECT k,
        CAST(FLOOR(k / 20) AS BIGINT) AS page_id,
        CAST(ROW_NUMBER() OVER (PARTITION BY FLOOR(k / 20) ORDER BY k) - 1 AS INTEGER) AS pos,
        CASE WHEN Name IS NULL THEN NULL
             ELSE Name || CASE WHEN k % 17 = 0 THEN ' & Sons' ELSE '' END END AS name,
        Rating AS rating, "Rating Count" AS rating_count,
        CASE WHEN k % 19 = 0 THEN NULL
             ELSE 'https://listing.example/overview/' || CAST(k AS VARCHAR) END AS link,
        Headquarters, Company_year, "Employees Count"
    FROM keyed
)"""


def DECODE(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                    ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


LINKS = r"""page_links AS (
    SELECT page_id, UNNEST(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS raw_href
    FROM pages
), links AS (SELECT page_id, """ + DECODE("raw_href") + """ AS href FROM page_links)"""

EXTRACTION: dict[str, str] = {}

EXTRACTION["cards_extract"] = "WITH " + FIELDS + """
SELECT page_id, pos, name, rating, rating_count, link FROM expected_cards"""

EXTRACTION["detail_enrich"] = "WITH " + FIELDS + f"""
SELECT page_id, pos, name, rating, rating_count, link,
    CASE WHEN link IS NULL OR k % 4 = 3 OR Company_year IS NULL THEN NULL
         ELSE Company_year END AS founded_year,
    CASE WHEN link IS NULL OR k % 3 = 2 OR Headquarters IS NULL THEN NULL
         ELSE Headquarters END AS headquarters,
    CASE WHEN link IS NULL THEN NULL ELSE {EMP('"Employees Count"')} END AS employees
FROM expected_cards"""

EXTRACTION["url_frontier"] = "WITH " + FIELDS + """
SELECT DISTINCT CAST(FLOOR(k / 20) + 1 AS BIGINT) AS page,
       'https://listing.example/companies?page=' || CAST(CAST(FLOOR(k / 20) + 1 AS BIGINT) AS VARCHAR)
           AS url
FROM keyed"""

EXTRACTION["page_ads"] = r"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, """ + DECODE("ads[i]") + r""" AS ad_text
FROM (SELECT page_id, ads, UNNEST(generate_series(1, len(ads))) AS i
      FROM (SELECT page_id,
                   regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ads
            FROM pages))"""

EXTRACTION["page_headings"] = r"""
SELECT page_id, """ + DECODE(
    r"""regexp_replace(regexp_extract_all(html, '(?s)<h1(?:\s[^>]*)?>(.*?)</h1>', 1)[1],
                       '<[^>]*>', '', 'g')""") + r""" AS heading
FROM pages"""

EXTRACTION["page_links"] = "WITH " + LINKS + "\nSELECT page_id, href FROM links"

EXTRACTION["distinct_links"] = "WITH " + LINKS + "\nSELECT DISTINCT href FROM links"

EXTRACTION["link_counts"] = "WITH " + LINKS + """
SELECT COUNT(*) AS total_links, COUNT(DISTINCT href) AS unique_links FROM links"""

EXTRACTION["page_charset"] = r"""
SELECT page_id, regexp_extract_all(html, '<meta\s[^>]*?charset="([^"]*)"', 1)[1] AS charset
FROM pages"""

EXTRACTION["page_preview"] = """
SELECT page_id, substring(html, 1, 2000) AS preview FROM pages"""

EXTRACTION["listing_names"] = "WITH " + FIELDS + """
SELECT page_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos, name
FROM expected_cards WHERE name IS NOT NULL"""

EXTRACTION["cards_by_sql"] = EXTRACTION["cards_extract"]
EXTRACTION["elements_by_sql"] = EXTRACTION["page_ads"]

# Page by page: how often each was fetched, and stretches of neighbours in one state.
CRAWLED = """WITH log AS (
    SELECT o_custkey * 5 + o_orderkey % 4 AS a,
           CASE WHEN o_orderkey % 31 = 0 THEN o_custkey * 5 + o_orderkey % 4 - 2
                WHEN o_orderkey % 37 <> 0 THEN o_custkey * 5 + o_orderkey % 4 + o_orderkey % 3
           END AS b
    FROM orders
), fetched AS (
    SELECT page, count(*) AS times FROM log, unnest(range(a, b + 1)) AS t(page) GROUP BY page
), pages AS (
    SELECT CAST(p.page AS BIGINT) AS page, coalesce(times, 0) AS times
    FROM range(101, (SELECT max(b) FROM log) + 51) AS p(page) LEFT JOIN fetched USING (page)
)"""

EXTRACTION["page_frontier"] = CRAWLED + """, states AS (
    SELECT page, CASE WHEN times = 0 THEN 'missing' ELSE 'repeated' END AS state
    FROM pages WHERE times <> 1
), runs AS (
    SELECT page, state, page - row_number() OVER (PARTITION BY state ORDER BY page) AS run
    FROM states
)
SELECT state, min(page) AS first, max(page) AS last FROM runs GROUP BY state, run"""

EXTRACTION["frontier_urls"] = CRAWLED + """
SELECT page, 'https://listing.example/companies?page=' || page AS url FROM pages WHERE times = 0"""
