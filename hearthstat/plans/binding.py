"""Survey roles on the given relational tables.

Each role is one SQL text that Spark and DuckDB both read, so a query and its SQL twin see the same rows.
``{orders}`` and the like stand for the table: a DataFrame in Spark, a view name in DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from hearthstat.sources.io import read_table

_STATE = "lpad(CAST(c_nationkey AS STRING), 2, '0')"
_AREA20 = f"concat({_STATE}, lpad(CAST(c_custkey % 4 AS STRING), 3, '0'))"
_AREA10 = (
    f"CASE WHEN c_custkey % 50 = 0 THEN concat({_STATE}, '-0009') "
    f"ELSE concat({_STATE}, lpad(CAST(c_custkey % 3 AS STRING), 3, '0')) END"
)

# Household columns that come from the order row alone.
_HOUSEHOLD = """
    CAST(o_orderkey AS STRING) AS serialno,
    CASE WHEN o_orderkey % 40 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice / 10000) AS BIGINT) + 1 END AS wgtp,
    CAST(o_orderkey % 6 AS INT) AS np,
    CASE WHEN o_orderkey % 11 = 0 THEN '1' WHEN o_orderkey % 37 = 0 THEN NULL ELSE '2' END AS fs,
    CASE o_orderpriority WHEN '5-LOW' THEN '3' WHEN '4-NOT SPECIFIED' THEN '2' ELSE '1' END AS accessinet,
    CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '2' END AS hispeed,
    CASE WHEN o_orderkey % 7 = 0 THEN '1' ELSE '2' END AS othsvcex,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '1' ELSE '2' END AS dialup,
    CASE WHEN o_orderkey % 13 = 0 THEN '1' ELSE '2' END AS satellite,
    CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice / 4 END AS hincp,
    CAST(o_orderkey % 3 AS STRING) AS r65"""

# Person columns that come from the line item row alone.
_PERSON = """
    CAST(l_orderkey AS STRING) AS serialno,
    l_linenumber AS sporder,
    CAST(floor(l_quantity) AS BIGINT) AS pwgtp,
    CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(floor(l_quantity * 10) AS INT) END AS povpip,
    CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_returnflag = 'R' AND l_suppkey % 4 = 0 THEN '1' ELSE '2' END AS hins4,
    CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN l_extendedprice ELSE 0.0 END AS pap,
    CASE WHEN l_partkey % 29 = 0 THEN l_extendedprice ELSE 0.0 END AS ssip,
    lpad(CAST(l_suppkey % 20 AS STRING), 2, '0') AS vps,
    CASE WHEN l_partkey % 8 = 0 THEN '1' ELSE '0' END AS racblk,
    lpad(CAST(l_partkey % 30 + 1 AS STRING), 2, '0') AS hisp,
    lpad(CAST(l_suppkey % 17 AS STRING), 2, '0') AS schg"""

# Orders with their area; areas without links are left out.
_LINKED_ORDERS = (
    f"(SELECT o_orderkey, {_AREA10} AS puma_id FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey "
    "WHERE c_custkey % 50 <> 0) linked"
)
# Line items counted per linked area and part, before any part column is joined: a frequent part is one row per area.
_PER_PART = (
    f"(SELECT puma_id, l_partkey, count(*) AS n FROM {{lineitem}} JOIN {_LINKED_ORDERS} ON l_orderkey = o_orderkey "
    "GROUP BY 1, 2) per_part"
)
_TRACT = "lpad(CAST(p_size % 10 AS STRING), 11, '0')"

ROLES: dict[str, str] = {
    # Households without area columns, for national totals keyed on the serial number.
    "households": f"SELECT {_HOUSEHOLD} FROM {{orders}}",
    # Households with state and both area vintages.
    "area_households": f"""
        SELECT {_STATE} AS state_id, {_AREA20} AS area20, {_AREA10} AS area10, {_HOUSEHOLD}
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "persons": f"SELECT {_PERSON} FROM {{lineitem}}",
    # Persons with both area vintages of their household, for keys of two and three columns.
    "area_persons": f"""
        SELECT {_AREA20} AS area20, {_AREA10} AS area10, {_PERSON}
        FROM {{lineitem}}
            JOIN (SELECT o_orderkey, c_custkey, c_nationkey FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey) placed
            ON l_orderkey = o_orderkey""",
    # Crosswalk area -> district: share of line items per supplier nation. Areas ending -0009 have no link.
    # Line items are counted per area and supplier before the supplier table is joined.
    "area_district": f"""
        SELECT puma_id, district, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY puma_id) AS allocation_factor
        FROM (
            SELECT puma_id, lpad(CAST(s_nationkey AS STRING), 2, '0') AS district, CAST(sum(n) AS BIGINT) AS n
            FROM (
                SELECT puma_id, l_suppkey, count(*) AS n
                FROM {{lineitem}} JOIN {_LINKED_ORDERS} ON l_orderkey = o_orderkey
                GROUP BY 1, 2) per_supplier
                JOIN {{supplier}} ON l_suppkey = s_suppkey
            GROUP BY 1, 2) counted""",
    # Crosswalk area -> zip: share of line items per brand.
    "area_zip": f"""
        SELECT puma_id, zipcode, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY puma_id) AS allocation_factor
        FROM (
            SELECT puma_id, p_brand AS zipcode, CAST(sum(n) AS BIGINT) AS n
            FROM {_PER_PART} JOIN {{part}} ON l_partkey = p_partkey
            GROUP BY 1, 2) counted""",
    # Crosswalk zip -> rural / urban.
    "zip_rural": """
        SELECT zip, urban_rural_code, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY zip) AS allocation_factor
        FROM (
            SELECT p_brand AS zip, CASE WHEN p_size <= 20 THEN 'R' ELSE 'U' END AS urban_rural_code, count(*) AS n
            FROM {part} GROUP BY 1, 2) counted""",
    # Crosswalk area -> tract.
    "area_tract": f"""
        SELECT puma22_id, tract_id, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY puma22_id) AS allocation_factor
        FROM (
            SELECT puma_id AS puma22_id, {_TRACT} AS tract_id, CAST(sum(n) AS BIGINT) AS n
            FROM {_PER_PART} JOIN {{part}} ON l_partkey = p_partkey
            GROUP BY 1, 2) counted""",
    "locations": f"""
        SELECT CAST(p_partkey AS STRING) AS location_id,
            concat({_TRACT}, lpad(CAST(p_partkey % 10000 AS STRING), 4, '0')) AS block_fips,
            CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS served_by_copper_100_20,
            CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS served_by_coaxcable_100_20,
            CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS INT) AS served_by_fiber_100_20
        FROM {{part}}""",
    # Block groups with a cost indicator as text.
    "cost_groups": f"""
        SELECT {_STATE} AS state_id,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 'true' ELSE 'false' END AS high_cost_indicator,
            CAST(c_custkey % 7 + 1 AS BIGINT) AS total_households
        FROM {{customer}}""",
    # State table with several years.
    "states": f"""
        SELECT {_STATE} AS state_id, n_name AS geo_name, CAST(year(o_orderdate) AS INT) AS year,
            CAST(sum(CAST(floor(o_totalprice / 10000) AS BIGINT) + 1) AS BIGINT) AS total_households
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
        GROUP BY 1, 2, 3""",
    "zip_population": """
        SELECT p_brand AS zip, year,
            CAST(sum(quantity) AS BIGINT) AS total_hh_population,
            CAST(sum(CASE WHEN l_partkey % 8 = 0 THEN quantity ELSE 0 END) AS BIGINT) AS total_black,
            CAST(sum(CASE WHEN l_partkey % 30 > 0 AND l_partkey % 30 < 24 THEN quantity ELSE 0 END) AS BIGINT) AS total_hispanic
        FROM (
            SELECT l_partkey, CAST(year(l_shipdate) AS INT) AS year, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS quantity
            FROM {lineitem} GROUP BY 1, 2) per_part
            JOIN {part} ON l_partkey = p_partkey
        GROUP BY 1, 2""",
    "zip_households": """
        SELECT p_brand AS zip, year, CAST(sum(n) AS BIGINT) AS total_households
        FROM (SELECT l_partkey, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM {lineitem} GROUP BY 1, 2) per_part
            JOIN {part} ON l_partkey = p_partkey
        GROUP BY 1, 2""",
    # Raw subscriber records with the month as text.
    "subscriber_records": """
        SELECT CAST(year(o_orderdate) AS INT) AS support_year, CAST(month(o_orderdate) AS INT) AS support_month,
            concat(lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING)) AS month_text,
            CAST(o_orderkey % 50 AS BIGINT) AS subscribers, CAST(floor(o_totalprice) AS BIGINT) AS disbursed
        FROM {orders}""",
    # Funding ledger per state and year, and for the whole country.
    "state_ledger": f"""
        SELECT {_STATE} AS state_id, CAST(year(o_orderdate) AS INT) AS year,
            CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS committed,
            CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS available
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
        GROUP BY 1, 2""",
    # Monthly enrolment per state: months counted from January 1995.
    "state_enrolment": f"""
        SELECT {_STATE} AS state_id,
            CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS months,
            CAST(count(*) AS BIGINT) AS enrolled
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
        GROUP BY 1, 2""",
}

_TABLE = re.compile(r"\{(\w+)\}")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame over the Parquet tables of ``sf_dir``."""
    text = ROLES[name]
    tables = {table: read_table(spark, table, sf_dir) for table in set(_TABLE.findall(text))}
    return spark.sql(text, **tables)


def role_views(names: Sequence[str]) -> str:
    """The roles as common table expressions over tables of the same names as the placeholders."""
    return "WITH " + ", ".join(f"{name} AS ({_TABLE.sub(r'\1', ROLES[name])})" for name in names)
