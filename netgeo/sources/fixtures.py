"""Test inputs derived from the driver tables.

The range table and the query stream are *derived by SQL* from ``customer``,
``nation``, ``region`` and ``events`` so that they grow with the scale factor.
The same SQL text runs unchanged in Spark SQL and DuckDB: Spark gets the
DataFrames through ``spark.sql(text, name=df)`` placeholders, the oracle gets
plain view names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = ("customer", "nation", "region", "events")

# Fixed fixture definition (documented in FIXTURES.md).  Placeholders {customer}
# {nation} {region} {events} are filled with DataFrames (Spark) or view names
# (DuckDB oracle).
_PREFIX_TEMPLATE = """
WITH
c0 AS (
  SELECT c_custkey AS k, c_nationkey AS nk, c_mktsegment AS seg, n_name, r_name
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
                  JOIN {region} ON n_regionkey = r_regionkey),
c1 AS (
  SELECT *,
    CASE WHEN k % 50 = 10 THEN 16777216 + (k - 2) * 1024 + 256
         WHEN k % 5 = 4   THEN 16777216 + (k - 1) * 1024 + 256
         ELSE 16777216 + k * 1024 END AS f,
    CASE WHEN k % 50 = 10 OR k % 5 = 4 THEN 256
         WHEN k % 3 = 0 THEN 1024 WHEN k % 3 = 1 THEN 512 ELSE 256 END AS sz
  FROM c0),
c2 AS (
  SELECT *, f + sz - 1 AS t,
    CAST((f >> 24) & 255 AS STRING) || '.' || CAST((f >> 16) & 255 AS STRING) || '.' ||
    CAST((f >> 8) & 255 AS STRING) || '.' || CAST(f & 255 AS STRING) AS s
  FROM c1),
ip_raw AS (
  SELECT k AS range_id,
    CASE WHEN k % 53 = 0 THEN '-' ELSE CAST(f AS STRING) END AS ip_from,
    CASE WHEN k % 53 = 0 THEN '-' ELSE CAST(t AS STRING) END AS ip_to,
    CAST(f AS STRING) AS ip_numeric,
    s AS ip_start,
    CAST((t >> 24) & 255 AS STRING) || '.' || CAST((t >> 16) & 255 AS STRING) || '.' ||
    CAST((t >> 8) & 255 AS STRING) || '.' || CAST(t & 255 AS STRING) AS ip_end,
    CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN s WHEN k % 43 = 0 THEN s || '/x'
         ELSE s || '/' || CASE sz WHEN 1024 THEN '22' WHEN 512 THEN '23' ELSE '24' END END AS cidr,
    'IN' AS country,
    CASE WHEN k % 61 = 0 THEN '-' ELSE r_name END AS state,
    CASE WHEN k % 499 = 3 THEN 'Solo_' || CAST(k AS STRING) WHEN k % 47 = 0 THEN NULL WHEN k % 71 = 0 THEN '' WHEN k % 59 = 0 THEN 'Rare_' || CAST(k % 9 AS STRING)
         WHEN k % 13 = 0 THEN '  City_' || CAST(nk AS STRING) || ' ' ELSE 'City_' || CAST(nk AS STRING) END AS city,
    CASE WHEN k % 7 = 0 THEN 'Unknown' ELSE 'Isp' || CAST(nk % 6 AS STRING) END AS isp,
    CASE WHEN k % 29 = 0 THEN NULL WHEN k % 31 = 0 THEN 'AS12' ELSE CAST(1000 + nk * 7 AS STRING) END AS asn,
    CASE WHEN k % 17 = 0 THEN '-' ELSE seg || ' ' || n_name || ' NET LTD' END AS asn_description,
    CASE WHEN k % 4 = 0 THEN 'no_rdns' WHEN k % 19 = 0 THEN ''
         ELSE CASE k % 3 WHEN 0 THEN 'Static-' WHEN 1 THEN 'dynamic.broadband.' ELSE 'mail.' END ||
              CAST(k % 97 AS STRING) || CASE k % 5 WHEN 0 THEN '.mumbai' WHEN 1 THEN '.pune' ELSE '' END ||
              '.isp' || CAST(nk % 6 AS STRING) || '.net' END AS rdns_hostname,
    CASE WHEN k % 23 = 0 THEN '-' ELSE CAST(8 + nk AS STRING) || '.' || CAST(10 + k % 90 AS STRING) END AS lat,
    CASE WHEN k % 23 = 1 THEN '-' ELSE CAST(68 + nk AS STRING) || '.' || CAST(10 + k % 80 AS STRING) END AS lon,
    CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(5 + k % 200 AS STRING) || '.5' END AS local_rtt_ms,
    CASE k % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'true' ELSE '-' END AS reachable
  FROM c2),
q0 AS (
  SELECT event_id AS q, ts, 16776700 + (event_id * 7919) % ((SELECT count(*) FROM {customer}) * 1066) AS v FROM {events}),
ip_queries AS (
  SELECT q AS query_id, ts,
    CASE q % 40 WHEN 0 THEN '999.1.1.1' WHEN 1 THEN '1.2.3' WHEN 2 THEN '01.2.3.4' WHEN 3 THEN ' 1.0.0.1'
      WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'abc' WHEN 7 THEN '::1' ELSE
      CAST((v >> 24) & 255 AS STRING) || '.' || CAST((v >> 16) & 255 AS STRING) || '.' ||
      CAST((v >> 8) & 255 AS STRING) || '.' || CAST(v & 255 AS STRING) END AS ip
  FROM q0)
"""


def sql_prefix() -> str:
    """CTE prefix for DuckDB oracle queries (tables are pre-registered views)."""
    return _PREFIX_TEMPLATE.format(**{t: t for t in SOURCE_TABLES})


def _source_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCE_TABLES}


def ip_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range table as a CSV reader would see it (all STRING but range_id)."""
    return spark.sql(_PREFIX_TEMPLATE + "SELECT * FROM ip_raw", **_source_frames(spark, sf_dir))


def ip_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query stream: query_id BIGINT, ts TIMESTAMP, ip STRING."""
    return spark.sql(_PREFIX_TEMPLATE + "SELECT * FROM ip_queries", **_source_frames(spark, sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
