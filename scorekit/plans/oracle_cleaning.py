"""DuckDB formulations of the cleaning and quality queries (see oracle_sql)."""

from __future__ import annotations

from .oracle_sql import COMPANIES, ORDER_COUNTS  # noqa: F401

RAW = ORDER_COUNTS + r""", raw_src AS (
    SELECT c.c_custkey AS k, c.c_name, c.c_mktsegment AS seg, nt.n_name AS nat, n.n,
           10 + FLOOR((c.c_acctbal + 1000) / 275) AS d,
           CAST(CASE WHEN c.c_custkey % 29 = 0 THEN 0
                     WHEN c.c_custkey % 97 = 0 THEN 2003
                     WHEN c.c_custkey % 31 = 0 THEN NULL
                     ELSE 2002 - c.c_custkey % 45 END AS INTEGER) AS yr
    FROM customer c JOIN nation nt ON c.c_nationkey = nt.n_nationkey
    LEFT JOIN ord_n n ON n.o_custkey = c.c_custkey
), raw_fields AS (
    SELECT k AS pos,
        CASE WHEN k % 61 = 0 THEN NULL ELSE c_name END AS Name,
        CASE WHEN k % 41 = 0 THEN NULL
             ELSE CAST(CAST(FLOOR(d / 10) AS BIGINT) AS VARCHAR) || '.'
                  || CAST(CAST(d % 10 AS BIGINT) AS VARCHAR) END AS Rating,
        CASE WHEN k % 43 = 0 THEN NULL
             WHEN k % 7 = 0 THEN CAST(n AS VARCHAR) || '.3L'
             WHEN k % 7 < 4 THEN CAST(n AS VARCHAR) || '.1k'
             ELSE CAST(n * 10 AS VARCHAR) END AS "Rating Count",
        CASE WHEN k % 47 = 0 THEN NULL
             WHEN k % 5 = 0 THEN seg || '.. ' || nat
             WHEN k % 5 = 1 THEN seg || ', United States of America'
             WHEN k % 53 = 0 THEN '...'
             ELSE seg || ', ' || nat || ',' END AS Headquarters,
        CASE WHEN yr = 0 THEN NULL ELSE CAST(yr AS VARCHAR) END AS Company_year,
        CASE WHEN k % 37 = 0 THEN NULL
             WHEN k % 6 = 0 THEN CAST(n AS VARCHAR) || '01-' || CAST(n + 1 AS VARCHAR) || 'k'
             WHEN k % 6 = 1 THEN '50k-1 lakh'
             WHEN k % 6 = 2 THEN '1 Lakh+'
             WHEN k % 6 = 3 THEN '0-10'
             WHEN k % 6 = 4 THEN '1,' || CAST(n + 100 AS VARCHAR)
             ELSE 'unknown' END AS "Employees Count"
    FROM raw_src
), companies_raw AS (
    SELECT 1 AS batch, * FROM raw_fields WHERE pos % 3 <> 0
    UNION ALL
    SELECT 2 AS batch, * FROM raw_fields WHERE pos % 3 <> 1
)"""


# What the units of scraped counts stand for.
UNITS = "MAP {'': 1, 'K': 1000, 'LAKH': 100000, 'L': 100000}"
#: A count: digits, then its unit somewhere in the words up to a dash.
COUNT = r"(\d+)(?:[^-]*?(lakh|k))?[^-]*"


def field(x: str, pattern: str, n: int) -> str:
    """Group ``n`` of a pattern; empty where it does not match."""
    return f"regexp_extract({x}, '{pattern}', {n}, 'i')"


def EMP(x: str) -> str:
    """A count, or the larger of two counts that are both above zero."""
    plain = f"replace({x}, ',', '')"

    def count(pattern: str, n: int) -> str:
        return (f"(TRY_CAST({field(plain, pattern, n)} AS BIGINT)"
                f" * {UNITS}[upper({field(plain, pattern, n + 1)})])")
    both = rf"^\s*{COUNT}-\s*{COUNT}$"
    low, high = count(both, 1), count(both, 3)
    return (f"(CASE WHEN contains({x}, '-') THEN CASE WHEN {low} > 0 AND {high} > 0 "
            f"THEN greatest({low}, {high}) END ELSE {count(COUNT, 1)} END)")


def RC(x: str) -> str:
    """A decimal number and perhaps a unit letter."""
    pattern = r"^\s*([0-9.]+)\s*([kl]?)\s*$"
    return (f"CAST(CAST(nullif({field(x, pattern, 1)}, '') AS DECIMAL(28,10))"
            f" * CAST({UNITS}[upper({field(x, pattern, 2)})] AS DECIMAL(6,0)) AS DOUBLE)")


def COUNTRY(x: str) -> str:
    """The last words between commas and dots; the United States by their short name."""
    last = field(x, r"([^,.\s][^,.]*?)[,.\s]*$", 1)
    return f"(CASE WHEN contains({last}, 'United States') THEN 'USA' ELSE nullif({last}, '') END)"


PARSED = RAW + f""", parsed AS (
    SELECT batch, pos, Name, Rating, Headquarters, Company_year,
           CAST({EMP('"Employees Count"')} AS DOUBLE) AS emp,
           {RC('"Rating Count"')} AS RatingCount,
           {COUNTRY('Headquarters')} AS Country
    FROM companies_raw
), filled AS (
    FROM parsed SELECT batch, pos, Name, TRY_CAST(Rating AS DOUBLE) AS Rating,
        ifnull(Headquarters, 'Unknown') AS Headquarters,
        ifnull(TRY_CAST(Company_year AS BIGINT), 0) AS Company_year,
        ifnull(emp, median(emp) OVER ()) AS "Employees Count", RatingCount,
        ifnull(Country, 'Unknown') AS Country
), clean AS (
    FROM filled WHERE Name IS NOT NULL AND Rating IS NOT NULL
    QUALIFY (batch, pos) = min((batch, pos)) OVER (PARTITION BY Name, Headquarters)
)"""

RAW_COLUMNS = ["Name", "Rating", "Rating Count", "Headquarters", "Company_year",
               "Employees Count"]

CLEANING: dict[str, str] = {}

CLEANING["clean_employees"] = "WITH " + RAW + f"""
SELECT batch, pos, "Employees Count" AS employees_text,
       {EMP('"Employees Count"')} AS employees
FROM companies_raw"""

CLEANING["clean_rating_count"] = "WITH " + RAW + f"""
SELECT batch, pos, "Rating Count" AS rating_count_text, {RC('"Rating Count"')} AS RatingCount
FROM companies_raw"""

CLEANING["extract_country"] = "WITH " + RAW + f"""
SELECT batch, pos, Headquarters, {COUNTRY('Headquarters')} AS Country FROM companies_raw"""

CLEANING["impute_median"] = "WITH " + PARSED + """
SELECT batch, pos, "Employees Count" AS employees FROM filled"""

CLEANING["impute_constants"] = "WITH " + PARSED + """
SELECT batch, pos, Headquarters, Country, Company_year FROM filled"""

CLEANING["merge_dedup_batches"] = "WITH " + PARSED + """
SELECT batch, pos, Name, Headquarters FROM clean"""

CLEANING["clean_companies"] = "WITH " + PARSED + """
SELECT Name, Rating, Headquarters, Company_year, "Employees Count", RatingCount, Country
FROM clean"""

CLEANING["load_companies"] = "WITH " + PARSED + """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY batch, pos) AS BIGINT) AS id, Name, Rating, Headquarters,
       CAST(Company_year AS INTEGER) AS Company_year,
       CAST(FLOOR("Employees Count" + 0.5) AS INTEGER) AS Employees_Count,
       CAST(FLOOR(RatingCount + 0.5) AS INTEGER) AS RatingCount, Country
FROM clean"""

CLEANING["null_profile"] = "WITH " + RAW + ", totals AS (SELECT COUNT(*) AS n FROM companies_raw)\n" \
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, CAST(SUM(CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END) AS BIGINT)
           AS null_count, SUM(CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END) / MAX(t.n) * 100 AS null_pct,
           CAST(MAX(t.n) AS BIGINT) AS row_count
    FROM companies_raw CROSS JOIN totals t""" for c in RAW_COLUMNS)

CLEANING["point_corrections"] = "WITH " + RAW + """, numbered AS (
    SELECT batch, pos, Headquarters, ROW_NUMBER() OVER (ORDER BY batch, pos) - 1 AS row_index
    FROM companies_raw)
SELECT batch, pos, row_index,
       CASE WHEN row_index = 17 THEN 'Noida, Uttar Pradesh' ELSE Headquarters END AS Headquarters
FROM numbered"""

CLEANING["streaming_ingest"] = "WITH " + PARSED + """
SELECT batch, pos, Name, Rating, Headquarters, Company_year, "Employees Count", RatingCount, Country
FROM clean"""

CLEANING["incremental_merge"] = CLEANING["merge_dedup_batches"]

CLEANING["distinct_sketch"] = "WITH " + PARSED.split(", filled AS")[0] + """
SELECT Country, count(DISTINCT Name) AS names, true AS within_3_percent
FROM parsed GROUP BY Country"""

_LIMITS = {"Name": 18, "Headquarters": 30}

CLEANING["column_profile"] = "WITH " + RAW + "\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, sum(n)::BIGINT AS row_count,
       coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS null_count,
       min(length(v))::INTEGER AS min_length, max(length(v))::INTEGER AS max_length,
       {f"coalesce(sum(n) FILTER (length(v) > {_LIMITS[c]}), 0)::BIGINT" if c in _LIMITS
        else "NULL::BIGINT"} AS over_limit,
       count(v) AS distinct_count, true AS estimate_within_3_percent,
       max(n) FILTER (v IS NOT NULL) AS top_count
FROM (SELECT "{c}" AS v, count(*) AS n FROM companies_raw GROUP BY 1)""" for c in RAW_COLUMNS)

CLEANING["table_report"] = "WITH " + RAW + """
SELECT count(*) AS row_count, 8 AS column_count,
       (SELECT count(*) FROM (FROM companies_raw SELECT pos GROUP BY pos HAVING count(*) > 1))
           AS duplicate_keys,
       count(*) FILTER (length(Name) > 18 OR length(Headquarters) > 30) AS over_length
FROM companies_raw"""

CLEANING["tolerant_load"] = "WITH " + RAW + """
SELECT batch, pos, CASE
    WHEN pos % 23 = 0 OR pos % 41 = 5 THEN 'malformed line'
    WHEN pos % 29 = 1 THEN 'Rating Count: not a number'
    WHEN pos % 37 = 3 THEN 'Rating: not a number'
    WHEN pos % 31 = 2 THEN 'Headquarters: over 255 characters'
    ELSE 'accepted' END AS outcome
FROM companies_raw"""


# Analyses over the cleaned and loaded table (scrape text -> clean -> load -> analysis).
def _loaded_companies() -> str:
    return PARSED + """, companies AS (
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY batch, pos) AS BIGINT) AS id, Name, Rating,
           Headquarters, CAST(Company_year AS INTEGER) AS Company_year,
           CAST(FLOOR("Employees Count" + 0.5) AS INTEGER) AS Employees_Count,
           CAST(FLOOR(RatingCount + 0.5) AS INTEGER) AS RatingCount, Country
    FROM clean)"""


def _on_loaded(name: str) -> str:
    from .oracle_sql import ANALYSES, COMPANIES
    return ANALYSES[name].replace(COMPANIES, _loaded_companies(), 1)


for _name in ("credibility_rank", "composite_rank", "hq_concentration"):
    CLEANING[_name + "_clean"] = _on_loaded(_name)
