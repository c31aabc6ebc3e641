"""Archive inputs derived from the given tables, in SQL that Spark and DuckDB both run.

Tables stand in braces: Spark gets DataFrames for them, DuckDB their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = """
SELECT event_type AS source_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'shop' END AS provider_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'Web Times' ELSE 'Shop Post' END AS provider_name,
  'publisher' AS provider_kind, event_type AS channel_id, upper(event_type) AS channel_label, 'section' AS channel_role,
  CASE WHEN event_type = 'view' THEN 'hot' ELSE 'latest' END AS stream_kind,
  CASE WHEN event_type = 'purchase' THEN 'entity' ELSE 'article' END AS item_kind,
  CASE WHEN event_type = 'purchase' THEN 'product' END AS entity_kind,
  CASE WHEN event_type = 'click' THEN 'flash' END AS item_variant,
  'en' AS language, 'GB' AS market, event_type <> 'error' AS enabled,
  CAST(600 + 60 * length(event_type) AS BIGINT) AS interval_seconds, CAST(50 AS BIGINT) AS max_items
FROM {events} GROUP BY event_type
"""

SURFACES = """
SELECT DISTINCT event_type AS source_id, CASE WHEN event_type IN ('click', 'error') THEN 'news' ELSE 'discover' END AS surface FROM {events}
UNION ALL SELECT DISTINCT event_type AS source_id, 'news' AS surface FROM {events} WHERE event_type = 'view'
"""

CANDIDATES = """
SELECT event_id AS obs_seq, run_id, CASE WHEN bucket % 7 = 3 THEN 'history' ELSE 'live' END AS run_kind, event_type AS source_id, provider_id, ts AS seen_at,
  CASE WHEN event_id % 97 = 0 THEN '  ' WHEN event_id % 11 = 0 THEN ' Story  ' || k || ' v' || v || ' ' ELSE 'Story ' || k || ' v' || v END AS title,
  CASE WHEN event_id % 89 = 0 THEN 'ftp://news.example/' || k
    WHEN event_id % 5 = 0 THEN 'HTTPS://News.Example:443/' || k || '?utm_source=feed&id=' || k
    WHEN event_id % 7 = 0 THEN 'http://user@news.example:8080/' || k || '?UTM_Campaign=z#top'
    ELSE 'https://news.example/' || k END AS url,
  CASE WHEN user_id % 3 <> 0 THEN CASE WHEN event_id % 13 = 0 THEN ' ' || user_id || ' ' ELSE '' || user_id END END AS external_id,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 79 = 0 THEN ts + INTERVAL 3 HOUR ELSE ts - INTERVAL 1 HOUR END AS published_at,
  CASE WHEN event_id % 4 <> 0 THEN 'raw ' || k END AS raw_published_at,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 83 END AS position, '{{"points":' || k || '}}' AS metrics,
  CASE WHEN event_type = 'purchase' THEN 'entity' ELSE 'article' END AS item_kind, CASE WHEN event_type = 'purchase' THEN 'product' END AS entity_kind,
  CASE WHEN event_type = 'click' THEN 'flash' END AS item_variant
FROM (
  SELECT *, bucket * 8 + CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS run_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'shop' END AS provider_id
  FROM (
    SELECT event_id, ts, user_id, event_type, CAST(floor(event_id / 250.0) AS BIGINT) AS bucket, CAST(floor(value) AS BIGINT) % 3 AS v,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
    FROM {events}) AS a) AS b
"""

# live runs that succeeded and listed nothing, behind the others of their bucket
EMPTY_RUNS = """
SELECT bucket * 8 + 5 AS run_id, 'live' AS run_kind, 'view' AS source_id, max(ts) + INTERVAL 1 SECOND AS observed_at
FROM (SELECT ts, CAST(floor(event_id / 250.0) AS BIGINT) AS bucket FROM {events}) AS e WHERE bucket % 3 = 0 GROUP BY bucket
"""

RUNS = """
SELECT run_id, run_kind, source_id, started_at, CASE WHEN newest AND source_id = 'click' THEN NULL WHEN newest AND source_id = 'view' THEN ended ELSE finished_at END AS finished_at,
  CASE WHEN newest AND source_id = 'click' THEN 'running' WHEN newest AND source_id = 'view' THEN 'failed' ELSE status END AS status,
  CASE WHEN newest AND source_id IN ('click', 'view') THEN NULL ELSE http_status END AS http_status, response_etag, response_last_modified, request_identity,
  CASE WHEN newest AND source_id = 'click' THEN NULL WHEN newest AND source_id = 'view' THEN 'AbandonedRun' ELSE error_type END AS error_type, error_message
FROM (SELECT *, run_kind = 'live' AND row_number() OVER (PARTITION BY source_id, run_kind ORDER BY run_id DESC) = 1 AS newest FROM (
SELECT run_id, CASE WHEN bucket % 7 = 3 THEN 'history' ELSE 'live' END AS run_kind, source_id, started_at, finished_at AS ended,
  CASE WHEN run_id % 13 = 5 THEN NULL ELSE finished_at END AS finished_at,
  CASE WHEN run_id % 13 = 5 THEN 'running' WHEN run_id % 5 = 1 THEN 'failed' WHEN run_id % 6 = 2 THEN 'not_modified' ELSE 'success' END AS status,
  CASE WHEN run_id % 13 = 5 THEN NULL WHEN run_id % 5 = 1 THEN 429 + 37 * (run_id % 3) WHEN run_id % 6 = 2 THEN 304 ELSE 200 END AS http_status,
  CASE WHEN run_id % 3 = 0 THEN NULL ELSE 'etag-' || run_id END AS response_etag,
  CASE WHEN run_id % 4 = 0 THEN NULL ELSE 'mod-' || run_id END AS response_last_modified,
  CASE WHEN run_id % 11 = 0 THEN 'other' ELSE 'same' END AS request_identity,
  CASE WHEN run_id % 13 <> 5 AND run_id % 5 = 1 THEN 'HTTPStatusError' END AS error_type,
  CASE WHEN run_id % 13 <> 5 AND run_id % 5 = 1 THEN 'status  of run ' || run_id END AS error_message
FROM (
  SELECT bucket * 8 + CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS run_id,
    bucket, event_type AS source_id, min(ts) AS started_at, max(ts) AS finished_at
  FROM (SELECT *, CAST(floor(event_id / 250.0) AS BIGINT) AS bucket FROM {events}) AS e GROUP BY bucket, event_type) AS r) AS s) AS t
"""

HEADS = """
SELECT page_id AS item_id, 'pages' || (page_id % 4) AS source_id, 'Pages — ' || (page_id % 4) AS source_name, 'article' AS item_kind, CAST(NULL AS {text}) AS entity_kind,
  CASE WHEN page_id % 9 = 0 THEN NULL ELSE page_id % 30 END AS position,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url,
  CAST(TIMESTAMP '2024-01-01 00:00:00' + CAST(page_id % 50 AS INT) * INTERVAL 1 HOUR AS {ts}) AS first_seen_at,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE CAST(TIMESTAMP '2023-12-01 00:00:00' + CAST(page_id % 70 AS INT) * INTERVAL 1 HOUR AS {ts}) END AS published_at
FROM {pages}
"""


def duck(sql: str) -> str:
    return sql.format(events="events", pages="pages", documents="documents", text="VARCHAR", ts="TIMESTAMP")


def view(spark: SparkSession, sf_dir: str, sql: str, spread: str | None = None) -> DataFrame:
    """The view over the Parquet tables of sf_dir; times stay UTC wall times without zone, as the tables have them.

    spread: a key by which the given rows are dealt out first. A file is read by no more tasks than it has row groups, and what is computed of its rows in the same stage by no more than these.
    """
    names = [n for n in ("events", "pages", "documents") if "{" + n + "}" in sql]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    if spread:
        tables = {n: t.repartition(spread) for n, t in tables.items()}
    return spark.sql(sql.replace("{text}", "STRING").replace("{ts}", "TIMESTAMP_NTZ"), **tables)
