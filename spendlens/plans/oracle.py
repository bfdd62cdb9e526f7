"""SQL of the registered queries for the independent engine, written from the definitions, not from the Spark plans.

Only the base tables are known there, so every statement carries the usage tables it needs as CTEs. Sums are exact
(DECIMAL) in both engines, so results are compared unrounded; computed doubles become DECIMAL by way of their text, which
rounds their shortest form half up in both engines.
"""

from __future__ import annotations

from ..operators import seasonal
from .testbed import FAULTY_DAYS

FOLD = "(DATE '2023-11-02' + CAST(date_diff('day', DATE '1995-01-01', CAST({} AS DATE)) % 90 AS INTEGER))"
START = "TIMESTAMP '2023-11-02 00:00:00'"  # fixed clock less 90 days
AS_OF = "DATE '2024-01-31'"
MONEY = "DECIMAL(18,6)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def avg(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / COUNT({x}))"


def ratio(n: str, d: str, other: str = "0.0") -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE CAST({other} AS DOUBLE) END"


def per_million(n: str, d: str, other: str = "0.0") -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * 1000000 ELSE CAST({other} AS DOUBLE) END"


def growth(cur: str, prev: str) -> str:
    return f"CASE WHEN {prev} <> 0 THEN (CAST({cur} AS DOUBLE) - CAST({prev} AS DOUBLE)) / CAST({prev} AS DOUBLE) * 100 END"


def cents(x: str, digits: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def number(x: str) -> str:
    return f"TRY_CAST({x} AS DECIMAL(38,0))"


EVENT_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
SERVERLESS = f"COUNT(*) FILTER (WHERE {number('warehouse_id')} IS NULL OR {number('warehouse_id')} = 0)"
COMPUTE = f"COUNT(*) FILTER (WHERE {number('warehouse_id')} > 0)"
TIE = (
    "md5(concat_ws('|', COALESCE(query_id, ''), COALESCE(operation_name, ''), COALESCE(model_name, ''), "
    "COALESCE(CAST(units_processed AS VARCHAR), ''), COALESCE(CAST(page_count AS VARCHAR), ''), "
    "COALESCE(CAST(document_count AS VARCHAR), '')))"
)

# name -> (names of the CTEs it reads, SQL)
CTES: dict[str, tuple[str, str]] = {}

CTES["fx_functions"] = ("", f"""
SELECT CAST({FOLD.format('l_shipdate')} AS TIMESTAMP) + to_hours(l_linenumber) AS usage_time,
       CAST(l_orderkey AS VARCHAR) AS query_id,
       CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '5-LOW' THEN -1 - o_custkey ELSE o_custkey END AS user_id,
       CASE l_returnflag WHEN 'A' THEN 'COMPLETE' WHEN 'N' THEN 'TRANSLATE' ELSE 'EMBED_TEXT_768' END AS function_name,
       CASE p_type WHEN 'STANDARD' THEN 'llama3.1-70b' WHEN 'LARGE' THEN 'llama3.1-405b' WHEN 'ECONOMY' THEN 'mistral-7b'
                   WHEN 'SMALL' THEN 'claude-3-haiku' WHEN 'MEDIUM' THEN 'in-house-1' END AS model_name,
       CASE l_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'n/a' ELSE CAST(l_suppkey AS VARCHAR) END AS warehouse_id,
       CAST(l_quantity - 1 AS BIGINT) * 100 AS tokens,
       CAST(l_extendedprice / 1000 AS {MONEY}) AS token_credits,
       '{{"input": ' || CAST(CAST(l_quantity - 1 AS BIGINT) * 100 AS VARCHAR) || '}}' AS tokens_granular,
       '{{"tier": "' || l_linestatus || '"}}' AS token_credits_granular
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")

CTES["fx_analyst"] = ("", f"""
SELECT ts AS start_time, ts + INTERVAL 1 MINUTE AS end_time,
       CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'user_' || CAST(user_id AS VARCHAR) END AS username,
       CAST(value / 100 AS {MONEY}) AS credits, {EVENT_K} AS request_count
FROM events WHERE event_type IN ('click', 'view')""")

CTES["fx_search"] = ("", f"""
SELECT CAST(ts AS DATE) AS usage_date, 'sales' AS database_name, 'public' AS schema_name,
       'svc_' || CAST(user_id % 5 AS VARCHAR) AS service_name, user_id % 5 AS service_id,
       CASE WHEN user_id % 2 = 0 THEN 'EMBED_TEXT_TOKENS' ELSE 'SERVING' END AS consumption_type,
       SUM(CAST(value / 100 AS {MONEY})) AS credits, 'embed-small' AS model_name,
       CASE WHEN user_id % 5 = 4 THEN 'n/a' ELSE CAST(SUM({EVENT_K}) AS VARCHAR) END AS tokens
FROM events WHERE event_type = 'signup' GROUP BY CAST(ts AS DATE), user_id % 5, user_id % 2""")

CTES["fx_serving"] = ("", f"""
SELECT ts AS start_time, ts + INTERVAL 1 MINUTE AS end_time, 'sales' AS database_name, 'public' AS schema_name,
       'svc_' || CAST(user_id % 5 AS VARCHAR) AS service_name, user_id % 5 AS service_id,
       CAST(value / 100 AS {MONEY}) AS credits
FROM events WHERE event_type = 'error'""")

CTES["fx_documents"] = ("", f"""
SELECT CASE WHEN lang = 'es' THEN 'ext_' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS query_id,
       CAST({FOLD.format('o_orderdate')} AS TIMESTAMP) AS start_time,
       CAST({FOLD.format('o_orderdate')} AS TIMESTAMP) + INTERVAL 5 MINUTE AS end_time,
       CASE WHEN lang = 'en' THEN 'PARSE_DOCUMENT' ELSE 'AI_EXTRACT' END AS function_name,
       lang AS model_name, source AS operation_name, n_chars // 1800 AS page_count, CAST(1 AS BIGINT) AS document_count,
       n_chars % 7 AS feature_count, CAST(CAST(n_chars AS DOUBLE) / 10000 AS {MONEY}) AS credits_used
FROM documents JOIN orders ON doc_id = o_orderkey""")

CTES["fx_legacy"] = ("", f"""
SELECT 'page_' || CAST(page_id AS VARCHAR) AS query_id,
       CAST(DATE '2023-11-02' + CAST(page_id % 90 AS INTEGER) AS TIMESTAMP) AS start_time,
       CAST(DATE '2023-11-02' + CAST(page_id % 90 AS INTEGER) AS TIMESTAMP) + INTERVAL 5 MINUTE AS end_time,
       split_part(url, '/', 4) AS operation_name, length(html) // 2000 AS page_count, CAST(1 AS BIGINT) AS document_count,
       length(html) % 7 AS feature_count, CAST(CAST(length(html) AS DOUBLE) / 10000 AS {MONEY}) AS credits_used
FROM pages""")

CTES["fx_tuning"] = ("", f"""
SELECT ts AS start_time, ts + INTERVAL 1 HOUR AS end_time, 'model_' || CAST(user_id % 4 AS VARCHAR) AS model_name,
       CAST(value / 10 AS {MONEY}) AS token_credits, {EVENT_K} * 1000 AS tokens
FROM events WHERE event_type = 'purchase'""")

CTES["fx_users"] = ("", "SELECT c_custkey AS user_id, c_name AS name FROM customer")

CTES["fx_queries"] = ("", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS query_id, c_name AS user_name,
       CAST({FOLD.format('o_orderdate')} AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS start_time,
       'SELECT * FROM V_' || o_orderpriority AS query_text,
       CASE WHEN o_orderstatus = 'F' THEN '100035' END AS error_code,
       CASE WHEN o_orderstatus = 'F' THEN 'timeout in ' || o_orderpriority END AS error_message,
       CAST(ROUND(o_totalprice) AS BIGINT) AS total_elapsed_time, o_orderkey * 1024 AS bytes_scanned,
       o_custkey % 100 AS partitions_scanned
FROM orders JOIN customer ON o_custkey = c_custkey""")

CTES["fx_metering"] = ("", f"""
SELECT {FOLD.format('o_orderdate')} AS usage_date,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'AI_SERVICES' ELSE 'WAREHOUSE_METERING' END AS service_type,
       CAST(o_totalprice / 1000 AS {MONEY}) AS credits_used, CAST(o_totalprice * 9 / 10000 AS {MONEY}) AS credits_used_compute,
       CAST(o_totalprice / 10000 AS {MONEY}) AS credits_used_cloud_services
FROM orders""")

CTES["fx_accounts"] = ("", f"""
SELECT 'acct_' || CAST(c_nationkey AS VARCHAR) AS account, {FOLD.format('o_orderdate')} AS date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Analyst' WHEN '2-HIGH' THEN 'Search' WHEN '3-MEDIUM' THEN 'Functions'
            WHEN '4-NOT SPECIFIED' THEN 'Document Processing' ELSE 'Fine-tuning' END AS service_type,
       COUNT(DISTINCT o_custkey) AS daily_unique_users,
       CAST(SUM(CAST(FLOOR(o_totalprice / 50) AS BIGINT)) AS BIGINT) AS total_operations,
       SUM(CAST(o_totalprice / 1000 AS {MONEY})) AS total_credits
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")

CTES["account_days"] = ("fx_accounts", f"""
SELECT account, date AS usage_date, service_type, daily_unique_users, total_operations, total_credits,
       {ratio('total_credits', 'daily_unique_users')} AS credits_per_user,
       {ratio('total_credits', 'total_operations')} AS credits_per_operation
FROM fx_accounts""")

CTES["fx_uploaded"] = ("", f"""
SELECT 'acct_' || CAST(c_nationkey AS VARCHAR) AS account, DATE '2023-11-02' + CAST(c_custkey % 90 AS INTEGER) AS date,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Analyst' WHEN 'AUTOMOBILE' THEN 'Search' WHEN 'FURNITURE' THEN 'Functions'
            WHEN 'MACHINERY' THEN 'Document Processing' ELSE 'Legacy Bot' END AS service_type,
       c_custkey % 50 AS daily_unique_users, c_custkey AS total_operations,
       CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey % 2 = 0 THEN NULL
            ELSE CAST(c_acctbal / 1000 AS {MONEY}) + CAST(0.9 AS {MONEY}) END AS total_credits
FROM customer""")

CTES["uploaded_days"] = ("fx_uploaded", f"""
SELECT account, date AS usage_date, service_type, daily_unique_users, total_operations, total_credits,
       {ratio('total_credits', 'daily_unique_users')} AS credits_per_user
FROM fx_uploaded""")

# --- views ------------------------------------------------------------------------------------------------------------

CTES["attribution"] = ("fx_analyst fx_functions fx_users fx_documents fx_queries", f"""
SELECT *, {ratio('credits_used', 'operations', 'NULL')} AS credits_per_operation FROM (
  SELECT CAST(start_time AS DATE) AS usage_date, username AS user_name, 'Analyst' AS service_type,
         'Analyst' AS feature_name, CAST(NULL AS VARCHAR) AS model_name, SUM(credits) AS credits_used,
         {big('SUM(request_count)')} AS operations
  FROM fx_analyst WHERE start_time >= {START} GROUP BY 1, 2
  UNION ALL
  SELECT CAST(usage_time AS DATE), name, 'Functions', function_name, model_name, SUM(token_credits), {big('SUM(tokens)')}
  FROM fx_functions f LEFT JOIN fx_users u ON f.user_id = u.user_id WHERE usage_time >= {START} GROUP BY 1, 2, 4, 5
  UNION ALL
  SELECT CAST(q.start_time AS DATE), q.user_name, 'Document Processing', d.function_name, d.model_name,
         SUM(d.credits_used), {big('SUM(d.page_count)')}
  FROM fx_documents d JOIN fx_queries q ON d.query_id = q.query_id WHERE q.start_time >= {START} GROUP BY 1, 2, 4, 5
)""")

CTES["daily"] = ("attribution fx_search fx_tuning", f"""
SELECT *, {ratio('total_credits', 'daily_unique_users')} AS credits_per_user,
       {ratio('total_credits', 'total_operations')} AS credits_per_operation
FROM (
  SELECT CAST(start_time AS DATE) AS usage_date, 'Analyst' AS service_type, COUNT(DISTINCT username) AS daily_unique_users,
         {big('SUM(request_count)')} AS total_operations, SUM(credits) AS total_credits
  FROM fx_analyst WHERE start_time >= {START} GROUP BY 1
  UNION ALL
  SELECT usage_date, 'Search', 0,
         {big(f"SUM(CASE WHEN consumption_type = 'EMBED_TEXT_TOKENS' THEN COALESCE({number('tokens')}, 0) ELSE 0 END)")},
         SUM(credits)
  FROM fx_search WHERE usage_date >= {START} GROUP BY 1
  UNION ALL
  SELECT t.usage_date, 'Functions', COALESCE(u.users, 0), t.operations, t.credits
  FROM (SELECT CAST(usage_time AS DATE) AS usage_date, {big('SUM(tokens)')} AS operations, SUM(token_credits) AS credits
        FROM fx_functions WHERE usage_time >= {START} GROUP BY 1) t
  LEFT JOIN (SELECT usage_date, COUNT(DISTINCT user_name) AS users FROM attribution
             WHERE service_type = 'Functions' GROUP BY 1) u ON t.usage_date = u.usage_date
  UNION ALL
  SELECT t.usage_date, 'Document Processing', COALESCE(u.users, 0), t.operations, t.credits
  FROM (SELECT CAST(start_time AS DATE) AS usage_date, {big('SUM(page_count)')} AS operations, SUM(credits_used) AS credits
        FROM fx_documents WHERE start_time >= {START} GROUP BY 1) t
  LEFT JOIN (SELECT usage_date, COUNT(DISTINCT user_name) AS users FROM attribution
             WHERE service_type = 'Document Processing' GROUP BY 1) u ON t.usage_date = u.usage_date
  UNION ALL
  SELECT CAST(start_time AS DATE), 'Fine-tuning', 0, {big('SUM(tokens)')}, SUM(token_credits)
  FROM fx_tuning WHERE start_time >= {START} GROUP BY 1
)""")

_EXPORT_COLUMNS = f"""daily_unique_users, daily_unique_users AS weekly_active_users,
       daily_unique_users AS monthly_active_users, total_operations, total_credits, credits_per_user, credits_per_operation,
       {cents('credits_per_user', 4)} AS avg_daily_cost_per_user,
       {cents('credits_per_user * 30')} AS projected_monthly_cost_per_user,
       {cents('total_credits * 30')} AS projected_monthly_total_credits"""

CTES["export"] = ("daily", f"SELECT usage_date AS date, service_type, {_EXPORT_COLUMNS} FROM daily")

CTES["function_summary"] = ("fx_functions", f"""
SELECT function_name, model_name, COUNT(DISTINCT query_id) AS call_count, SUM(token_credits) AS total_credits,
       {big('SUM(tokens)')} AS total_tokens, {avg('token_credits')} AS avg_credits_per_call, {avg('tokens')} AS avg_tokens_per_call,
       MIN(usage_time) AS first_usage, MAX(usage_time) AS last_usage, {SERVERLESS} AS serverless_calls, {COMPUTE} AS compute_calls,
       {per_million('SUM(token_credits)', 'SUM(tokens)')} AS cost_per_million_tokens,
       date_diff('day', CAST(MIN(usage_time) AS DATE), CAST(MAX(usage_time) AS DATE)) + 1 AS days_in_use
FROM fx_functions WHERE usage_time >= {START} GROUP BY 1, 2""")

CTES["models"] = ("fx_functions", f"""
SELECT model_name, COUNT(DISTINCT function_name) AS functions_used, COUNT(DISTINCT query_id) AS total_calls,
       SUM(token_credits) AS total_credits, {big('SUM(tokens)')} AS total_tokens, {avg('token_credits')} AS avg_credits_per_call,
       {avg('tokens')} AS avg_tokens_per_call, MIN(usage_time) AS first_usage, MAX(usage_time) AS last_usage,
       ROUND(QUANTILE_CONT({dbl('token_credits')}, 0.50), 9) AS median_credits,
       ROUND(QUANTILE_CONT({dbl('token_credits')}, 0.90), 9) AS p90_credits,
       {per_million('SUM(token_credits)', 'SUM(tokens)')} AS cost_per_million_tokens
FROM fx_functions WHERE usage_time >= {START} AND model_name IS NOT NULL GROUP BY 1""")

CTES["trends"] = ("fx_functions", f"""
SELECT CAST(usage_time AS DATE) AS usage_date, function_name, model_name, COUNT(DISTINCT query_id) AS hourly_records,
       SUM(token_credits) AS daily_credits, {big('SUM(tokens)')} AS daily_tokens, {SERVERLESS} AS serverless_calls,
       {COMPUTE} AS compute_calls
FROM fx_functions WHERE usage_time >= {START} GROUP BY 1, 2, 3""")

CTES["query_costs"] = ("fx_functions fx_documents", f"""
SELECT *, {per_million('credits_used', 'units_processed', 'NULL')} AS cost_per_million_units,
       {ratio('credits_used', 'page_count', 'NULL')} AS cost_per_page,
       ROW_NUMBER() OVER (PARTITION BY service_category ORDER BY credits_used DESC, {TIE}) AS cost_rank
FROM (
  SELECT 'LLM Functions' AS service_category, query_id, function_name AS operation_name, model_name,
         token_credits AS credits_used, tokens AS units_processed, CAST(NULL AS BIGINT) AS page_count,
         CAST(NULL AS BIGINT) AS document_count
  FROM fx_functions WHERE usage_time >= {START}
  UNION ALL
  SELECT 'Document Processing', query_id, function_name, model_name, credits_used, NULL, page_count, document_count
  FROM fx_documents WHERE start_time >= {START}
) WHERE credits_used > 0""")

CTES["metered"] = ("fx_metering", f"""
SELECT usage_date, service_type, SUM(credits_used) AS total_credits, SUM(credits_used_compute) AS compute_credits,
       SUM(credits_used_cloud_services) AS cloud_services_credits
FROM fx_metering WHERE service_type = 'AI_SERVICES' AND usage_date >= {START} GROUP BY 1, 2""")

_NO_FEATURE = "CAST(NULL AS VARCHAR)"
_NO_COUNT = "CAST(NULL AS BIGINT)"
_NO_RATE = "CAST(NULL AS DOUBLE)"


def _features(excluded: str) -> str:
    page_rate = "CAST(CASE WHEN page_count > 0 THEN CAST(credits_used AS DOUBLE) / page_count ELSE 0 END AS DECIMAL(28,9))"
    doc_rate = "CAST(CASE WHEN document_count > 0 THEN CAST(credits_used AS DOUBLE) / document_count ELSE 0 END AS DECIMAL(28,9))"
    token_rate = f"CAST({per_million('token_credits', 'tokens')} AS DECIMAL(28,6))"
    return f"""
SELECT service_type, usage_date, daily_unique_users, total_operations, total_credits, credits_per_user,
       credits_per_operation, {_NO_FEATURE} AS function_name, {_NO_FEATURE} AS model_name, {_NO_COUNT} AS total_tokens,
       {_NO_RATE} AS cost_per_million_tokens, {_NO_COUNT} AS serverless_calls, {_NO_COUNT} AS compute_calls,
       {_NO_COUNT} AS total_pages_processed, {_NO_COUNT} AS total_documents_processed, {_NO_RATE} AS credits_per_page,
       {_NO_RATE} AS credits_per_document
FROM daily WHERE service_type NOT IN ({excluded})
UNION ALL
SELECT 'Function Models', usage_date, 0, hourly_records, daily_credits, 0, {ratio('daily_credits', 'hourly_records')},
       function_name, model_name, daily_tokens, {per_million('daily_credits', 'daily_tokens')}, serverless_calls,
       compute_calls, NULL, NULL, NULL, NULL
FROM trends
UNION ALL
SELECT 'Document Processing', CAST(d.start_time AS DATE), COUNT(DISTINCT q.user_name), {big('SUM(page_count)')},
       SUM(credits_used), 0, {avg(page_rate)}, function_name, model_name, NULL, NULL, NULL, NULL, {big('SUM(page_count)')},
       {big('SUM(document_count)')}, {avg(page_rate)}, {avg(doc_rate)}
FROM fx_documents d LEFT JOIN fx_queries q ON d.query_id = q.query_id
WHERE d.start_time >= {START} GROUP BY CAST(d.start_time AS DATE), function_name, model_name
UNION ALL
SELECT 'Fine-tuning', CAST(start_time AS DATE), 0, COUNT(*), SUM(token_credits), 0, {avg('token_credits')}, NULL,
       model_name, {big('SUM(tokens)')}, {avg(token_rate)}, NULL, NULL, NULL, NULL, NULL, NULL
FROM fx_tuning WHERE start_time >= {START} GROUP BY CAST(start_time AS DATE), model_name"""


CTES["features"] = ("daily trends fx_documents fx_queries fx_tuning",
                    _features("'Function Models', 'Document Processing', 'Fine-tuning', 'Functions'"))
CTES["features_repeated"] = ("daily trends fx_documents fx_queries fx_tuning",
                             _features("'Function Models', 'Document Processing', 'Fine-tuning'"))

CTES["snapshots"] = ("features", f"""
SELECT CAST(usage_date + lag_days AS DATE) AS snapshot_date, features.*,
       CAST(CAST(usage_date + lag_days AS DATE) AS TIMESTAMP) + INTERVAL 3 HOUR AS inserted_at
FROM features, (VALUES (0), (1), (2)) AS lags(lag_days) WHERE usage_date + lag_days <= {AS_OF}""")

CTES["latest_snapshots"] = ("snapshots", """
SELECT * FROM snapshots
QUALIFY ROW_NUMBER() OVER (PARTITION BY service_type, usage_date, COALESCE(function_name, ''), COALESCE(model_name, '')
                           ORDER BY snapshot_date DESC) = 1""")

CTES["history"] = ("latest_snapshots", f"""
SELECT *, {growth('total_credits', 'credits_7d_ago')} AS credits_wow_growth_raw FROM (
  SELECT date, service_type, {_EXPORT_COLUMNS}, snapshot_date, inserted_at, total_pages_processed,
         total_documents_processed, {ratio('total_credits', 'total_pages_processed')} AS credits_per_page,
         {ratio('total_credits', 'total_documents_processed')} AS credits_per_document,
         LAG(total_credits, 7) OVER (PARTITION BY service_type ORDER BY date) AS credits_7d_ago
  FROM (SELECT *, {ratio('total_credits', 'daily_unique_users')} AS credits_per_user,
               {ratio('total_credits', 'total_operations')} AS credits_per_operation
        FROM (SELECT usage_date AS date, service_type, {big('SUM(daily_unique_users)')} AS daily_unique_users,
                     {big('SUM(total_operations)')} AS total_operations, SUM(total_credits) AS total_credits,
                     MAX(snapshot_date) AS snapshot_date, MAX(inserted_at) AS inserted_at,
                     {big('SUM(total_pages_processed)')} AS total_pages_processed,
                     {big('SUM(total_documents_processed)')} AS total_documents_processed
              FROM latest_snapshots GROUP BY 1, 2)))""")


def _anomalies(source: str, series: str, earlier7: str, earlier14: str, week: str, high: str, medium: str) -> str:
    g = "((CAST(total_credits AS DOUBLE) - CAST(credits_7d_ago AS DOUBLE)) / NULLIF(CAST(credits_7d_ago AS DOUBLE), 0))"
    pct = f"CAST(CAST(ROUND({growth('total_credits', 'credits_7d_ago')}, 0) AS BIGINT) AS VARCHAR)"
    drop = f"CAST(CAST(ROUND(ABS({growth('total_credits', 'credits_7d_ago')}), 0) AS BIGINT) AS VARCHAR)"
    return f"""
SELECT date, {series}, total_credits, credits_7d_ago, credits_14d_ago, credits_7d_avg, daily_unique_users, total_operations,
       ROUND({growth('total_credits', 'credits_7d_ago')}, 2) AS wow_growth_pct,
       ROUND(total_credits - credits_7d_ago, 4) AS wow_credits_change,
       ROUND({growth('total_credits', 'credits_14d_ago')}, 2) AS two_week_growth_pct,
       ROUND({growth('total_credits', 'credits_7d_avg')}, 2) AS deviation_from_avg_pct,
       CASE WHEN {g} > {high} THEN 'HIGH' WHEN {g} > {medium} THEN 'MEDIUM' WHEN {g} < 0 THEN 'DECLINING' ELSE 'NORMAL' END AS alert_level,
       CASE WHEN {g} > {high} THEN 'HIGH ALERT: ' || service_type || ' credits increased ' || {pct} || '% vs last week'
            WHEN {g} > {medium} THEN 'MEDIUM ALERT: ' || service_type || ' credits increased ' || {pct} || '% vs last week'
            WHEN {g} < -{medium} THEN 'DECLINING: ' || service_type || ' credits decreased ' || {drop} || '% vs last week'
            ELSE 'NORMAL: No significant change detected' END AS alert_message,
       CASE WHEN {g} > {high} THEN 'INVESTIGATE: Review query patterns and user activity for ' || service_type
            WHEN {g} > {medium} THEN 'MONITOR: Track ' || service_type || ' usage closely over next few days'
            WHEN {g} < -{medium} THEN 'REVIEW: Check if decrease in ' || service_type || ' is expected'
            ELSE 'Continue normal monitoring' END AS recommended_action
FROM (SELECT * EXCLUDE (usage_date), usage_date AS date, {earlier7} AS credits_7d_ago,
             {earlier14} AS credits_14d_ago,
             CAST(SUM(total_credits) OVER ({week}) AS DOUBLE) / COUNT(total_credits) OVER ({week}) AS credits_7d_avg
      FROM {source} WHERE usage_date >= CAST({START} AS DATE))
WHERE credits_7d_ago IS NOT NULL"""


def _row_anomalies(source: str, series: str, high: str = "0.50", medium: str = "0.25") -> str:
    w = f"PARTITION BY {series} ORDER BY usage_date"
    return _anomalies(
        source, series, f"LAG(total_credits, 7) OVER ({w})", f"LAG(total_credits, 14) OVER ({w})",
        f"{w} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW", high, medium,
    )


CTES["anomalies"] = ("daily", _row_anomalies("daily", "service_type"))
CTES["account_anomalies"] = ("account_days", _row_anomalies("account_days", "account, service_type"))


CTES["threshold_days"] = ("account_days", """
SELECT d.*, COALESCE(TRY_CAST(CASE WHEN n % 2 = 0 AND n % 6 = 0 THEN 'much' WHEN n % 2 = 0 THEN CAST(CAST(0.05 * (n % 7 + 4) AS DECIMAL(4,2)) AS VARCHAR) END AS DOUBLE), 0.50::DOUBLE) AS high,
       CASE WHEN n % 4 = 0 THEN 0.10::DOUBLE ELSE 0.25::DOUBLE END AS medium
FROM (SELECT *, CAST(replace(account, 'acct_', '') AS INTEGER) AS n FROM account_days) d""")
CTES["configured_anomalies"] = ("threshold_days", _row_anomalies("threshold_days", "account, service_type", "high", "medium"))


def _at(days: int) -> str:
    return (
        "MAX(total_credits) OVER (PARTITION BY account, service_type ORDER BY usage_date "
        f"RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL {days} DAY PRECEDING)"
    )


CTES["calendar_anomalies"] = ("account_days", _anomalies(
    "account_days", "account, service_type", _at(7), _at(14),
    "PARTITION BY account, service_type ORDER BY usage_date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW",
    "0.60", "0.30",
))


def _current(source: str, series: str) -> str:
    return f"""
SELECT date, {series}, total_credits, credits_7d_ago, wow_growth_pct, wow_credits_change, alert_level, alert_message,
       recommended_action, daily_unique_users,
       CAST(CASE alert_level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'DECLINING' THEN 1 ELSE 0 END AS BIGINT) AS priority_score
FROM {source} WHERE date >= {AS_OF} - 7 AND alert_level IN ('HIGH', 'MEDIUM')"""


CTES["current_alerts"] = ("anomalies", _current("anomalies", "service_type"))
CTES["account_alerts"] = ("account_anomalies", _current("account_anomalies", "account, service_type"))

CTES["series"] = ("latest_snapshots", f"""
SELECT service_type, CAST(usage_date AS TIMESTAMP) AS ts, SUM(total_credits) AS y
FROM latest_snapshots WHERE usage_date >= {AS_OF} - 365 GROUP BY 1, 2""")

_SLOPE = "CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0.0 END"

CTES["fit"] = ("series", f"""
SELECT *, (sy - slope * sx) / n AS intercept FROM (
  SELECT *, {_SLOPE} AS slope FROM (
    SELECT service_type, {dbl('COUNT(*)')} AS n, {dbl('SUM(x)')} AS sx, {dbl('SUM(x * x)')} AS sxx, {dbl('SUM(y)')} AS sy,
           {dbl('SUM(y * CAST(x AS DECIMAL(8,0)))')} AS sxy, MAX(day) AS last_day, MAX(x) AS last_x
    FROM (SELECT service_type, CAST(ts AS DATE) AS day, CAST(y AS DECIMAL(28,12)) AS y,
                 date_diff('day', MIN(CAST(ts AS DATE)) OVER (PARTITION BY service_type), CAST(ts AS DATE)) AS x FROM series)
    GROUP BY 1)) WHERE n >= 14""")

CTES["residuals"] = ("fit", """
SELECT f.service_type, n, dayofweek(CAST(ts AS DATE)) AS weekday,
       CAST(CAST(y AS DECIMAL(28,12)) AS DOUBLE) - (intercept + slope
            * date_diff('day', MIN(CAST(ts AS DATE)) OVER (PARTITION BY f.service_type), CAST(ts AS DATE))) AS residual
FROM series s JOIN fit f ON s.service_type = f.service_type""")

CTES["weekdays"] = ("residuals", """
SELECT service_type, weekday, CAST(SUM(CAST(CAST(residual AS VARCHAR) AS DECIMAL(28,9))) AS DOUBLE) / COUNT(*) AS effect
FROM residuals GROUP BY 1, 2""")

CTES["spread"] = ("weekdays", """
SELECT service_type,
       SQRT(CAST(SUM(CAST(CAST(e / scale * (e / scale) AS VARCHAR) AS DECIMAL(28,18))) AS DOUBLE) / (MAX(n) - 1)) * MAX(scale) AS sigma
FROM (SELECT service_type, n, e, CASE WHEN largest > 0 THEN largest ELSE 1.0 END AS scale
      FROM (SELECT r.service_type, n, residual - effect AS e, MAX(ABS(residual - effect)) OVER (PARTITION BY r.service_type) AS largest
            FROM residuals r JOIN weekdays w ON r.service_type = w.service_type AND r.weekday = w.weekday))
GROUP BY 1""")

CTES["forecast"] = ("spread", """
SELECT service_type, forecast_date, GREATEST(0.0, v) AS forecast_credits, GREATEST(0.0, v - 1.96 * sigma) AS lower_bound_credits,
       GREATEST(0.0, v + 1.96 * sigma) AS upper_bound_credits
FROM (SELECT f.service_type, last_day + CAST(h AS INTEGER) AS forecast_date, sigma,
             intercept + slope * (last_x + h) + COALESCE(effect, 0.0) AS v
      FROM fit f JOIN spread s ON f.service_type = s.service_type CROSS JOIN range(1, 366) AS t(h)
      LEFT JOIN weekdays w ON w.service_type = f.service_type AND w.weekday = dayofweek(last_day + CAST(h AS INTEGER)))""")

CTES["forecast_months"] = ("forecast", """
SELECT CAST(date_trunc('month', forecast_date) AS DATE) AS month, service_type,
       SUM(CAST(CAST(forecast_credits AS VARCHAR) AS DECIMAL(28,12))) AS forecast_credits,
       SUM(CAST(CAST(lower_bound_credits AS VARCHAR) AS DECIMAL(28,12))) AS lower_bound_credits,
       SUM(CAST(CAST(upper_bound_credits AS VARCHAR) AS DECIMAL(28,12))) AS upper_bound_credits
FROM forecast WHERE forecast_date < (SELECT MIN(forecast_date) FROM forecast) + 180 GROUP BY 1, 2""")


_SETS = ", ".join(f"({number}, {', '.join(f'CAST({x!r} AS DOUBLE)' for x in values)})" for number, *values in seasonal.GRID)

CTES["account_arrays"] = ("fx_accounts", f"""
SELECT account, service_type, list(y ORDER BY day) AS ys, MIN(day) AS first_day
FROM (SELECT d.account, d.service_type, d.day, COALESCE(CAST(a.total_credits AS DOUBLE), 0.0) AS y
      FROM (SELECT account, service_type, CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS day
            FROM (SELECT * FROM fx_accounts WHERE account <> 'acct_9' OR date >= {AS_OF} - 15) GROUP BY 1, 2) d
      LEFT JOIN fx_accounts a ON a.account = d.account AND a.service_type = d.service_type AND a.date = d.day)
GROUP BY 1, 2""")


def _smoothed(ys: str, source: str) -> str:
    mean = f"(({' + '.join(f'{ys}[{i}]' for i in range(1, 8))}) / 7)"
    second = f"(({' + '.join(f'{ys}[{i}]' for i in range(8, 15))}) / 7)"
    return f"""
SELECT * FROM (
WITH RECURSIVE begun AS (
  SELECT account, service_type, {ys} AS v, len({ys}) AS n, GREATEST(7, len({ys}) // 5) AS held, s.*, {mean} AS level0
  FROM {source} CROSS JOIN (VALUES {_SETS}) AS s(set_no, alpha, beta, gamma, ab, gs) WHERE len({ys}) >= 21
), turns AS (
  SELECT account, service_type, v, n, held, set_no, alpha, beta, gamma, ab, gs, 7 AS t, level0 AS level, ({second.replace(ys, 'v')} - level0) / 7 AS trend,
         [x - level0 for x in v[1:7]] AS season, CAST(0 AS DOUBLE) AS sse FROM begun
  UNION ALL
  SELECT account, service_type, v, n, held, set_no, alpha, beta, gamma, ab, gs, t + 1, level + trend + alpha * e, trend + ab * e,
         list_append(season[2:7], season[1] + gs * e), sse + CASE WHEN t >= n - held THEN e * e ELSE 0.0 END
  FROM (SELECT *, v[t + 1] - (level + trend + season[1]) AS e FROM turns WHERE t < n)
)
SELECT account, service_type, held, alpha, beta, gamma, ab, gs, level, trend, season, SQRT(sse / held) AS sigma
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account, service_type ORDER BY sse, set_no) AS place FROM turns WHERE t = n) WHERE place = 1)"""


CTES["account_smoothed"] = ("account_arrays", _smoothed("ys", "account_arrays"))
CTES["account_cut"] = ("account_arrays", """
SELECT *, LEAST(28, len(ys) // 4) AS tested, ys[1 : len(ys) - LEAST(28, len(ys) // 4)] AS known FROM account_arrays""")
CTES["account_smoothed_cut"] = ("account_cut", _smoothed("known", "account_cut"))
CTES["account_errors"] = ("account_smoothed_cut", """
SELECT account, service_type, place, model, CAST(CAST(ys[len(known) + h] - value AS VARCHAR) AS DECIMAL(28,9)) AS off
FROM (
  SELECT *, unnest([0, 1, 2]) AS place, unnest(['seasonal', 'linear', 'last_week']) AS model, unnest([
    GREATEST(0.0, level + CAST(h AS DOUBLE) * trend + season[1 + (h - 1) % 7]),
    GREATEST(0.0, (sy - slope * sx) / n + slope * (n - 1 + h)), known[len(known) - 6 + (h - 1) % 7]]) AS value
  FROM (
    SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope
    FROM (
      SELECT c.*, s.level, s.trend, s.season, CAST(len(known) AS DOUBLE) AS n, l.sy, l.sxy,
             CAST(len(known) AS DOUBLE) * (CAST(len(known) AS DOUBLE) - 1) / 2 AS sx,
             CAST(len(known) AS DOUBLE) * (CAST(len(known) AS DOUBLE) - 1) * (2 * CAST(len(known) AS DOUBLE) - 1) / 6 AS sxx, CAST(unnest(range(1, tested + 1)) AS INTEGER) AS h
      FROM account_cut c JOIN account_smoothed_cut s USING (account, service_type)
      JOIN (SELECT account, service_type, sy, sxy FROM (
        WITH RECURSIVE sums AS (
          SELECT account, service_type, known AS v, 0 AS t, CAST(0 AS DOUBLE) AS sy, CAST(0 AS DOUBLE) AS sxy FROM account_cut
          UNION ALL
          SELECT account, service_type, v, t + 1, sy + v[t + 1], sxy + CAST(t AS DOUBLE) * v[t + 1] FROM sums WHERE t < len(v)
        ) SELECT * FROM sums WHERE t = len(v))) l USING (account, service_type)
    )
  )
)""")


def _account_line(horizon: int) -> str:
    return f"""
SELECT account, last_day + CAST(h AS INTEGER) AS date, GREATEST(0.0, (sy - slope * sx) / n + slope * (n - 1 + h)) AS forecast_credits
FROM (SELECT *, {_SLOPE} AS slope FROM (
        SELECT account, {dbl('COUNT(*)')} AS n, {dbl('SUM(x)')} AS sx, {dbl('SUM(x * x)')} AS sxx, {dbl('SUM(y)')} AS sy,
               {dbl('SUM(y * CAST(x AS DECIMAL(8,0)))')} AS sxy, MAX(day) AS last_day
        FROM (SELECT account, date AS day, CAST(SUM(total_credits) AS DECIMAL(28,12)) AS y,
                     ROW_NUMBER() OVER (PARTITION BY account ORDER BY date) - 1 AS x
              FROM fx_accounts GROUP BY account, date)
        GROUP BY account) WHERE n >= 7), range(1, {horizon + 1}) AS t(h)"""


CTES["account_line"] = ("fx_accounts", _account_line(366))
CTES["account_line_3m"] = ("fx_accounts", _account_line(91))

CTES["account_base"] = ("fx_accounts", f"""
SELECT account, service_type, {dbl('SUM(total_credits)')} AS base_credits, {avg('daily_unique_users')} AS base_users
FROM fx_accounts GROUP BY 1, 2""")

CTES["projection"] = ("account_base", f"""
SELECT *, {ratio('projected_cost_usd', 'projected_users')} AS cost_per_user_usd, {dbl('0.25')} AS growth_rate FROM (
  SELECT account, CAST(m AS INTEGER) AS month, service_type, base_credits * POW({dbl('1.25')}, m) AS projected_credits,
         base_users * POW({dbl('1.25')}, m) AS projected_users, base_credits * POW({dbl('1.25')}, m) * 3.0::DOUBLE AS projected_cost_usd
  FROM account_base, range(1, 13) AS t(m))""")

CTES["band"] = ("projection", """
SELECT account, month, CAST(c AS DOUBLE) AS projected_cost_usd, CAST(c AS DOUBLE) * 0.9::DOUBLE AS lower_bound,
       CAST(c AS DOUBLE) * 1.1::DOUBLE AS upper_bound,
       CAST(SUM(c) OVER (PARTITION BY account ORDER BY month) AS DOUBLE) AS cumulative_cost_usd
FROM (SELECT account, month, SUM(CAST(CAST(projected_cost_usd AS VARCHAR) AS DECIMAL(28,12))) AS c FROM projection GROUP BY 1, 2)""")


def _maturity(source: str, group: str) -> str:
    span = "date_diff('day', first_date, last_date) + 1"
    keys = f"{group}, " if group else ""
    group_by = f"GROUP BY {group}" if group else ""
    return f"""
SELECT *, CASE WHEN days = 0 THEN 0 ELSE CAST(FLOOR(LEAST(CAST(days AS DOUBLE) / 30, 1.0) * 60 + completeness * 40) AS BIGINT) END AS confidence_score,
       CASE WHEN days = 0 THEN 'none' WHEN days < 3 THEN 'insufficient' WHEN days < 14 THEN 'developing'
            WHEN days < 30 THEN 'reliable' ELSE 'confident' END AS level,
       CASE WHEN days = 0 THEN 'No Data' WHEN days < 3 THEN 'Insufficient' WHEN days < 7 THEN 'Developing'
            WHEN days < 14 THEN 'Improving' WHEN days < 30 THEN 'Reliable' ELSE 'High Confidence' END AS confidence_label,
       days >= 3 AS ready_for_projection
FROM (SELECT *, CASE WHEN days > 1 THEN CAST(days AS DOUBLE) / ({span}) ELSE 1.0 END AS completeness
      FROM (SELECT {keys}COUNT(DISTINCT date) AS days, MIN(date) AS first_date, MAX(date) AS last_date FROM {source} {group_by}))"""


CTES["maturity"] = ("fx_accounts", _maturity("fx_accounts", "account"))
CTES["maturity_overall"] = ("export", _maturity("export", ""))


def _executive(source: str, maturity: str, group: str) -> str:
    keys = f"{group}, " if group else ""
    group_by = f"GROUP BY {group}" if group else ""
    join = f"JOIN {maturity} m USING ({group})" if group else f"CROSS JOIN {maturity} m"
    return f"""
SELECT *, annual_cost * (1 - variance_pct) AS lower_bound, annual_cost * (1 + variance_pct) AS upper_bound
FROM (SELECT {keys}total_credits, avg_users, service_count, days, confidence_score, confidence_label, avg_daily_credits,
             avg_daily_credits * 30 AS monthly_credits, avg_daily_credits * 30 * 3.0::DOUBLE AS monthly_cost,
             avg_daily_credits * 30 * 12 * 3.0::DOUBLE AS annual_cost,
             CASE WHEN avg_users > 0 THEN avg_daily_credits * 30 * 3.0::DOUBLE / avg_users ELSE 0.0 END AS cost_per_user_month,
             GREATEST(0.05::DOUBLE, 0.30::DOUBLE - CAST(confidence_score AS DOUBLE) / 100 * 0.25::DOUBLE) AS variance_pct
      FROM (SELECT s.*, m.days, m.confidence_score, m.confidence_label,
                   CASE WHEN days > 0 THEN total_credits / days ELSE 0.0 END AS avg_daily_credits
            FROM (SELECT {keys}{dbl('SUM(total_credits)')} AS total_credits, {avg('daily_unique_users')} AS avg_users,
                         COUNT(DISTINCT service_type) AS service_count FROM {source} {group_by}) s {join}))"""


CTES["executive"] = ("maturity", _executive("fx_accounts", "maturity", "account"))
CTES["executive_overall"] = ("maturity_overall", _executive("export", "maturity_overall", ""))

CTES["scenarios"] = ("executive", """
SELECT *, projected_monthly_cost * 12 AS projected_annual_cost,
       CASE WHEN projected_users > 0 THEN projected_monthly_cost / projected_users ELSE 0.0 END AS cost_per_user
FROM (SELECT account, scenario, CAST(um AS DOUBLE) AS user_multiplier, CAST(gm AS DOUBLE) AS usage_multiplier, confidence_score,
             avg_users AS current_users, monthly_cost AS current_monthly_cost, avg_users * CAST(um AS DOUBLE) AS projected_users,
             monthly_cost * CAST(um AS DOUBLE) * CAST(gm AS DOUBLE) AS projected_monthly_cost
      FROM executive, (VALUES ('Light POC', 20.0, 1.5), ('Standard POC', 10.0, 1.2), ('Heavy POC', 4.0, 1.0)) AS s(scenario, um, gm))""")


def _breakdown(source: str, group: str) -> str:
    keys = f"{group}, " if group else ""
    group_by = f"GROUP BY {group}" if group else ""
    on = f"s.{group} = g.{group}" if group else "TRUE"
    return f"""
SELECT s.*, CAST(total_credits AS DOUBLE) * 3.0::DOUBLE AS total_cost_usd,
       CASE WHEN all_credits > 0 THEN CAST(total_credits AS DOUBLE) / CAST(all_credits AS DOUBLE) * 100 ELSE 0.0 END AS pct_of_total,
       CAST(total_credits AS DOUBLE) / all_days * 30 * 3.0::DOUBLE AS monthly_cost_usd,
       CAST(total_credits AS DOUBLE) / all_days * 30 * 3.0::DOUBLE * 12 AS annual_cost_usd
FROM (SELECT {keys}service_type, SUM(total_credits) AS total_credits, {avg('daily_unique_users')} AS avg_daily_users,
             {big('SUM(total_operations)')} AS total_operations FROM {source} GROUP BY {keys}service_type) s
JOIN (SELECT {keys}SUM(total_credits) AS all_credits, COUNT(DISTINCT date) AS all_days FROM {source} {group_by}) g ON {on}"""


CTES["breakdown"] = ("fx_accounts", _breakdown("fx_accounts", "account"))


def _rolling(frame: str) -> str:
    w = f"PARTITION BY account, service_type ORDER BY date {frame}"
    return f"""
SELECT *, CASE WHEN users_30d_avg > 0 THEN credits_30d_total / users_30d_avg ELSE 0.0 END AS cost_per_user_30d FROM (
  SELECT *, {dbl(f'SUM(total_credits) OVER ({w})')} AS credits_30d_total,
         {big(f'SUM(total_operations) OVER ({w})')} AS operations_30d_total,
         {dbl(f'SUM(daily_unique_users) OVER ({w})')} / COUNT(daily_unique_users) OVER ({w}) AS users_30d_avg
  FROM fx_accounts)"""


CTES["rolling"] = ("fx_accounts", _rolling("ROWS BETWEEN 29 PRECEDING AND CURRENT ROW"))

CTES["latest"] = ("rolling", """
SELECT account, service_type, date, credits_30d_total, operations_30d_total, users_30d_avg, cost_per_user_30d,
       credits_30d_total * 3.0::DOUBLE AS cost_30d_usd, cost_per_user_30d * 3.0::DOUBLE AS cost_per_user_30d_usd
FROM rolling QUALIFY ROW_NUMBER() OVER (PARTITION BY account, service_type ORDER BY date DESC) = 1""")

CTES["baseline"] = ("fx_accounts", f"""
SELECT *, CASE WHEN days_with_data > 0 THEN CAST(total_operations AS DOUBLE) / days_with_data ELSE 0.0 END AS requests_per_day,
       CASE WHEN total_operations > 0 THEN CAST(total_credits AS DOUBLE) * 3.0::DOUBLE / CAST(total_operations AS DOUBLE) ELSE 0.0 END AS cost_per_request
FROM (SELECT account, service_type, {big('SUM(total_operations)')} AS total_operations, {avg('daily_unique_users')} AS users_in_env,
             SUM(total_credits) AS total_credits, COUNT(date) AS days_with_data FROM fx_accounts GROUP BY 1, 2)""")

CTES["personas"] = ("baseline", """
SELECT *, requests_per_month * cost_per_request AS cost_per_user_month, requests_per_month * cost_per_request * users AS total_monthly_cost
FROM (SELECT account, persona, CAST(u AS BIGINT) AS users, CAST(r AS BIGINT) AS requests_per_day, CAST(r * 30 AS BIGINT) AS requests_per_month,
             CASE WHEN requests > 0 THEN cost / requests ELSE 0.0 END AS cost_per_request
      FROM (SELECT account, CAST(SUM(CAST(requests_per_day AS DECIMAL(38,9))) AS DOUBLE) * 30 AS requests,
                   CAST(SUM(CAST(requests_per_day * 30 * cost_per_request AS DECIMAL(38,9))) AS DOUBLE) AS cost
            FROM baseline GROUP BY 1), (VALUES ('Power User', 10, 50), ('Regular User', 30, 20)) AS p(persona, u, r))""")


def _facts(source: str, group: str) -> str:
    keys = f"{group}, " if group else ""
    group_by = f"GROUP BY {group}" if group else ""
    off = "daily_unique_users > 0 AND ABS(credits_per_user - CAST(total_credits AS DOUBLE) / daily_unique_users) > 0.01"
    dup = f"SELECT {keys}MAX(c) AS max_rows FROM (SELECT {keys}usage_date, service_type, COUNT(*) AS c FROM {source} GROUP BY ALL) {group_by}"
    on = f"USING ({group})" if group else "ON TRUE"
    return f"""
SELECT * FROM (
  SELECT {keys}COUNT(DISTINCT CASE WHEN usage_date >= {AS_OF} - 30 THEN usage_date END) AS recent_days,
         COUNT(DISTINCT CASE WHEN usage_date BETWEEN {AS_OF} - 30 AND {AS_OF} THEN usage_date END) AS covered_days,
         COUNT(*) FILTER (WHERE {off}) AS ratio_errors, COUNT(*) FILTER (WHERE total_credits < 0) AS negative_credits,
         COUNT(*) FILTER (WHERE daily_unique_users < 0) AS negative_users,
         COUNT(*) FILTER (WHERE service_type IS NULL) AS null_services, MIN(usage_date) AS first_date, MAX(usage_date) AS last_date
  FROM {source} {group_by}) JOIN ({dup}) {on}"""


CTES["facts"] = ("daily", _facts("daily", ""))
CTES["uploaded_facts"] = ("uploaded_days", _facts("uploaded_days", "account"))


def _score(source: str, group: str) -> str:
    keys = f"{group}, " if group else ""
    return f"""
SELECT *, ROUND(overall, 2) AS overall_quality_score, CASE WHEN overall >= 90 THEN 'EXCELLENT' WHEN overall >= 75 THEN 'GOOD'
       WHEN overall >= 60 THEN 'FAIR' ELSE 'POOR' END AS quality_rating
FROM (SELECT *, (completeness_score + accuracy_score + validity_score + consistency_score) / 4 AS overall
      FROM (SELECT {keys}CASE WHEN recent_days >= 25 THEN 100::DOUBLE ELSE recent_days * 100::DOUBLE / 30 END AS completeness_score,
                   100 - ratio_errors * 10 AS accuracy_score, 100 - (negative_credits + negative_users) * 5 AS validity_score,
                   CAST(CASE WHEN max_rows > 1 THEN 50 ELSE 100 END AS BIGINT) AS consistency_score FROM {source}))"""


def _checks(facts: str) -> str:
    return f"""
SELECT number AS test_number, category AS test_category, name AS test_name, status AS test_status, message AS test_message,
       0::DOUBLE AS execution_time_ms, TIMESTAMP '2024-01-31 03:00:00' AS tested_at
FROM (
  SELECT 7 AS number, 'Data Quality' AS category, 'No NULL service_type in daily summary' AS name,
         CASE WHEN null_services = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
         'Found ' || null_services || ' NULL service_type rows' AS message FROM {facts}
  UNION ALL SELECT 8, 'Data Quality', 'No negative credits in daily summary', CASE WHEN negative_credits = 0 THEN 'PASS' ELSE 'FAIL' END,
         'Found ' || negative_credits || ' rows with negative credits' FROM {facts}
  UNION ALL SELECT 9, 'Data Quality', 'Dates within lookback window',
         CASE WHEN first_date >= {AS_OF} - 90 AND last_date <= {AS_OF} THEN 'PASS' ELSE 'WARN' END,
         'Date range: ' || CAST(first_date AS VARCHAR) || ' to ' || CAST(last_date AS VARCHAR) FROM {facts}
  UNION ALL SELECT 10, 'Data Quality', 'No duplicate date-service combinations', CASE WHEN max_rows = 1 THEN 'PASS' ELSE 'FAIL' END,
         'Max occurrences per date-service: ' || max_rows FROM {facts}
  UNION ALL SELECT 11, 'Business Logic', 'credits_per_user calculated correctly', CASE WHEN ratio_errors = 0 THEN 'PASS' ELSE 'FAIL' END,
         CASE WHEN ratio_errors = 0 THEN 'All calculations correct' ELSE 'Found ' || ratio_errors || ' rows with incorrect calculations' END FROM {facts}
)"""


CTES["checks"] = ("facts", _checks("facts"))
CTES["faulty_days"] = ("account_days", f"SELECT {', '.join(FAULTY_DAYS)} FROM account_days")
CTES["faulty_facts"] = ("faulty_days", _facts("faulty_days", ""))
CTES["faulty_account_facts"] = ("faulty_days", _facts("faulty_days", "account"))
CTES["faulty_checks"] = ("faulty_facts", _checks("faulty_facts"))

CTES["settings_list"] = ("", """
SELECT * FROM (VALUES
  ('LOOKBACK_DAYS', '90', 'Default lookback period in days', 'INTEGER'),
  ('SNAPSHOT_RETENTION_DAYS', '365', 'Days to keep snapshots', 'INTEGER'),
  ('CREDIT_COST_USD', '3.00', 'Credit cost in USD', 'DECIMAL'),
  ('CREDIT_COST_EUR', '2.70', 'Credit cost in EUR', 'DECIMAL'),
  ('CREDIT_COST_GBP', '2.40', 'Credit cost in GBP', 'DECIMAL'),
  ('CREDIT_COST_JPY', '420.00', 'Credit cost in JPY', 'DECIMAL'),
  ('SNAPSHOT_SCHEDULE', '0 3 * * *', 'Daily snapshot schedule', 'STRING'),
  ('SNAPSHOT_TASK_WAREHOUSE', 'COMPUTE_WH', 'Compute used by the snapshot job', 'STRING'),
  ('ANOMALY_THRESHOLD_HIGH', '0.50', 'Week-over-week growth for HIGH alerts', 'DECIMAL'),
  ('ANOMALY_THRESHOLD_MEDIUM', '0.25', 'Week-over-week growth for MEDIUM alerts', 'DECIMAL'),
  ('FORECAST_ENABLED', 'TRUE', 'Compute forecasts', 'BOOLEAN'),
  ('FORECAST_HORIZON_DAYS', '365', 'Forecast horizon in days', 'INTEGER'),
  ('MIN_DATA_POINTS_FOR_FORECAST', '14', 'Days of data needed for a forecast', 'INTEGER'),
  ('MAX_CSV_UPLOAD_ROWS', '100000', 'Row count above which an upload is flagged', 'INTEGER'),
  ('ENABLE_USER_ATTRIBUTION', 'TRUE', 'Attribute spend to users', 'BOOLEAN'),
  ('ENABLE_QUERY_COST_ANALYSIS', 'TRUE', 'Analyse cost per query', 'BOOLEAN'),
  ('ENABLE_ML_FORECAST', 'FALSE', 'Use a trained forecast model', 'BOOLEAN'),
  ('DEFAULT_CURRENCY', 'USD', 'Display currency', 'STRING'),
  ('DECIMAL_PLACES', '2', 'Decimal places of displayed money', 'INTEGER'),
  ('CONFIG_VERSION', '1.0', 'Settings schema version', 'STRING'),
  ('DEPLOYMENT_DATE', '2024-01-31 03:00:00', 'Date of the deployment', 'TIMESTAMP')
) AS v(setting_name, setting_value, description, data_type)""")

CTES["default_settings"] = ("settings_list", "SELECT c_custkey AS account, settings_list.* FROM customer, settings_list")

CTES["settings"] = ("default_settings", """
SELECT COALESCE(t.account, s.account) AS account, COALESCE(t.setting_name, s.setting_name) AS setting_name,
       CASE WHEN t.account IS NOT NULL THEN t.setting_value ELSE s.setting_value END AS setting_value,
       CASE WHEN s.account IS NOT NULL THEN s.description ELSE t.description END AS description,
       CASE WHEN s.account IS NOT NULL THEN s.data_type ELSE t.data_type END AS data_type,
       CASE WHEN t.account IS NOT NULL THEN t.updated_at ELSE TIMESTAMP '2024-01-31 03:00:00' END AS updated_at,
       CASE WHEN t.account IS NOT NULL THEN t.updated_by ELSE 'deploy' END AS updated_by
FROM (SELECT c_custkey AS account, 'CREDIT_COST_USD' AS setting_name, CAST(c_nationkey AS VARCHAR) AS setting_value,
             'old text' AS description, 'STRING' AS data_type, TIMESTAMP '2023-12-01 00:00:00' AS updated_at, 'admin' AS updated_by
      FROM customer
      UNION ALL
      SELECT c_custkey, 'TEAM', c_mktsegment, 'Owning team', 'STRING', TIMESTAMP '2023-12-01 00:00:00', 'admin' FROM customer) t
FULL OUTER JOIN default_settings s ON t.account = s.account AND t.setting_name = s.setting_name""")


def _with(deps: str, sql: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0].split():
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in deps.split():
        add(name)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in needed) + "\n" + sql


# key -> (CTEs it reads, SELECT, double columns)
_QUERIES: dict[str, tuple[str, str, str]] = {}


def _q(key: str, deps: str, sql: str, doubles: str = "") -> None:
    _QUERIES[key] = (deps, sql, doubles)


_DETAIL = {
    "analyst_detail": ("fx_analyst", f"SELECT 'Analyst' AS service_type, CAST(start_time AS DATE) AS usage_date, * FROM fx_analyst WHERE start_time >= {START}", "credits"),
    "search_detail": ("fx_search", f"SELECT 'Search' AS service_type, * REPLACE (CAST({number('tokens')} AS DOUBLE) AS tokens) FROM fx_search WHERE usage_date >= {START}", "credits"),
    "search_serving_detail": ("fx_serving", f"SELECT 'Search Serving' AS service_type, CAST(start_time AS DATE) AS usage_date, * FROM fx_serving WHERE start_time >= {START}", "credits"),
    "search_long_tokens": ("fx_search", f"""SELECT service_name, consumption_type, CAST(SUM({number("concat(tokens, '7777777777777777')")}) AS VARCHAR) AS tokens,
        COUNT({number("concat(tokens, '7777777777777777')")}) AS numbers FROM fx_search WHERE usage_date >= {START} GROUP BY ALL""", ""),
    "functions_detail": ("fx_functions", f"""SELECT 'Functions' AS service_type, CAST(usage_time AS DATE) AS usage_date, usage_time AS start_time,
        usage_time + INTERVAL 1 HOUR AS end_time, function_name, model_name, CAST({number('warehouse_id')} AS DOUBLE) AS warehouse_id, token_credits, tokens
        FROM fx_functions WHERE usage_time >= {START}""", "token_credits"),
    "functions_query_detail": ("fx_functions", f"""SELECT 'Functions Query' AS service_type, query_id, CAST({number('warehouse_id')} AS DOUBLE) AS warehouse_id,
        model_name, function_name, tokens, token_credits, tokens_granular, token_credits_granular,
        {per_million('token_credits', 'tokens')} AS cost_per_million_tokens FROM fx_functions WHERE usage_time >= {START}""",
        "token_credits cost_per_million_tokens"),
    "document_legacy_detail": ("fx_legacy", f"SELECT 'Document Legacy' AS service_type, CAST(start_time AS DATE) AS usage_date, * FROM fx_legacy WHERE start_time >= {START}", "credits_used"),
    "document_detail": ("fx_documents", f"""SELECT 'Document Processing' AS service_type, CAST(start_time AS DATE) AS usage_date, *,
        {ratio('credits_used', 'page_count')} AS credits_per_page, {ratio('credits_used', 'document_count')} AS credits_per_document
        FROM fx_documents WHERE start_time >= {START}""", "credits_used credits_per_page credits_per_document"),
    "fine_tuning_detail": ("fx_tuning", f"""SELECT 'Fine-tuning' AS service_type, CAST(start_time AS DATE) AS usage_date, *,
        {per_million('token_credits', 'tokens')} AS cost_per_million_tokens FROM fx_tuning WHERE start_time >= {START}""",
        "token_credits cost_per_million_tokens"),
}
for _key, (_deps, _sql, _doubles) in _DETAIL.items():
    _q(_key, _deps, _sql, _doubles)

_USAGE_DOUBLES = "total_credits credits_per_user credits_per_operation"
_EXPORT_DOUBLES = _USAGE_DOUBLES + " avg_daily_cost_per_user projected_monthly_cost_per_user projected_monthly_total_credits"
_FUNCTION_DOUBLES = "total_credits avg_credits_per_call avg_tokens_per_call cost_per_million_tokens"
_SNAPSHOT_DOUBLES = "total_credits credits_per_user credits_per_operation cost_per_million_tokens credits_per_page credits_per_document"

# sources and sinks
_q("lookback_scan", "fx_analyst", "SELECT * FROM fx_analyst WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'", "credits")
for _key in ("csv_ingest", "csv_ingest_gzip"):
    _q(_key, "fx_accounts",
       "SELECT date, service_type, daily_unique_users, total_operations, total_credits, account FROM fx_accounts", "total_credits")
_q("csv_validation_report", "fx_uploaded", """
WITH f AS (
  SELECT account, COUNT(*) AS rows_, COUNT(*) FILTER (WHERE date IS NULL) AS bad_dates, COUNT(*) FILTER (WHERE total_credits < 0) AS negative,
         COUNT(*) FILTER (WHERE total_credits IS NULL) AS nulls,
         COUNT(*) FILTER (WHERE service_type NOT IN ('Analyst', 'Search', 'Functions', 'Document Processing', 'Fine-tuning')) AS unknown,
         date_diff('day', MIN(date), MAX(date)) AS span FROM fx_uploaded GROUP BY 1)
SELECT account, rule, findings, CASE WHEN findings > 0 THEN act ELSE 'OK' END AS outcome FROM (
  SELECT account, 'empty' AS rule, CAST(0 AS BIGINT) AS findings, 'REJECT' AS act FROM f
  UNION ALL SELECT account, 'too_many_rows', CASE WHEN rows_ > 100000 THEN rows_ ELSE 0 END, 'WARN' FROM f
  UNION ALL SELECT account, 'invalid_date', bad_dates, 'REJECT' FROM f
  UNION ALL SELECT account, 'long_date_range', CASE WHEN span > 730 THEN span ELSE 0 END, 'WARN' FROM f
  UNION ALL SELECT account, 'non_numeric_credits', 0, 'REJECT' FROM f
  UNION ALL SELECT account, 'negative_credits', negative, 'REJECT' FROM f
  UNION ALL SELECT account, 'null_credits', nulls, 'DROP_ROWS' FROM f
  UNION ALL SELECT account, 'unknown_service', unknown, 'WARN' FROM f)""")
_q("csv_validated_rows", "fx_uploaded", """
SELECT * FROM fx_uploaded WHERE total_credits IS NOT NULL
AND account NOT IN (SELECT account FROM fx_uploaded WHERE total_credits < 0)""", "total_credits")
_STORED = "'Analyst', 'Document Processing', 'Fine-tuning'"
_q("snapshot_or_live", "history export", f"""
SELECT date, service_type, daily_unique_users, total_operations, total_credits, credits_7d_ago,
       ROUND(credits_wow_growth_raw, 2) AS credits_wow_growth_pct, 'snapshot' AS origin
FROM history WHERE service_type IN ({_STORED})
UNION ALL
SELECT date, service_type, daily_unique_users, total_operations, total_credits, NULL, NULL, 'live'
FROM export WHERE service_type NOT IN (SELECT service_type FROM history WHERE service_type IN ({_STORED}))""",
   "total_credits credits_7d_ago credits_wow_growth_pct")
_q("user_spend_window", "attribution", f"SELECT * FROM attribution WHERE usage_date >= {AS_OF} - 30", "credits_used credits_per_operation")
_q("export_realtime", "export", f"""
SELECT date, service_type, daily_unique_users, total_operations, ROUND(total_credits, 8) AS total_credits,
       ROUND(credits_per_user, 8) AS credits_per_user, ROUND(credits_per_operation, 12) AS credits_per_operation
FROM export WHERE date >= {AS_OF} - 90""", _USAGE_DOUBLES)
_q("export_snapshot", "history", f"""
SELECT date, service_type, daily_unique_users, total_operations, ROUND(total_credits, 8) AS total_credits,
       ROUND(credits_per_user, 8) AS credits_per_user, ROUND(credits_per_operation, 12) AS credits_per_operation,
       ROUND(credits_7d_ago, 8) AS credits_7d_ago, ROUND(credits_wow_growth_raw, 2) AS credits_wow_growth_pct
FROM history WHERE date >= {AS_OF} - 90""", _USAGE_DOUBLES + " credits_7d_ago credits_wow_growth_pct")
_q("export_function_detail", "function_summary", """
SELECT function_name, model_name, call_count, ROUND(total_credits, 8) AS total_credits, total_tokens,
       ROUND(avg_credits_per_call, 8) AS avg_credits_per_call, ROUND(avg_tokens_per_call, 2) AS avg_tokens_per_call,
       ROUND(cost_per_million_tokens, 8) AS cost_per_million_tokens, serverless_calls, compute_calls, first_usage, last_usage
FROM function_summary""", _FUNCTION_DOUBLES)

_ALL = ["daily_unique_users", "total_operations", "total_credits", "credits_per_user", "credits_per_operation", "function_name",
        "model_name", "total_tokens", "cost_per_million_tokens", "serverless_calls", "compute_calls", "total_pages_processed",
        "total_documents_processed", "credits_per_page", "credits_per_document"]
_pick = ", ".join(f"CASE WHEN s.service_type IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in _ALL)
_q("snapshot_upsert", "features snapshots", f"""
WITH src AS (SELECT {AS_OF} AS snapshot_date, * FROM features WHERE usage_date BETWEEN {AS_OF} - 2 AND {AS_OF}),
tgt AS (
  SELECT snapshot_date, service_type, usage_date, {', '.join(_ALL)}, inserted_at FROM snapshots WHERE snapshot_date = {AS_OF} - 1
  UNION ALL
  SELECT snapshot_date, service_type, usage_date, {', '.join('0' if c == 'total_operations' else c for c in _ALL)},
         TIMESTAMP '2024-01-31 02:00:00' FROM src WHERE usage_date < {AS_OF} - 1)
SELECT COALESCE(t.snapshot_date, s.snapshot_date) AS snapshot_date, COALESCE(t.service_type, s.service_type) AS service_type,
       COALESCE(t.usage_date, s.usage_date) AS usage_date, {_pick},
       CASE WHEN s.service_type IS NOT NULL THEN TIMESTAMP '2024-01-31 03:00:00' ELSE t.inserted_at END AS inserted_at
FROM tgt t FULL OUTER JOIN src s ON t.snapshot_date = s.snapshot_date AND t.service_type = s.service_type
     AND t.usage_date = s.usage_date AND COALESCE(t.function_name, '') = COALESCE(s.function_name, '')
     AND COALESCE(t.model_name, '') = COALESCE(s.model_name, '')""", _SNAPSHOT_DOUBLES)
_q("config_upsert", "settings", "SELECT * FROM settings")
_q("config_value", "settings", "SELECT account, setting_value FROM settings WHERE setting_name = 'CREDIT_COST_USD'")
_q("config_typed", "settings", """
SELECT account, setting_name, data_type, CASE WHEN data_type = 'INTEGER' THEN TRY_CAST(setting_value AS BIGINT) END AS integer_value,
       CASE WHEN data_type = 'DECIMAL' THEN TRY_CAST(setting_value AS DECIMAL(38,12)) END AS decimal_value,
       CASE WHEN data_type = 'BOOLEAN' THEN TRY_CAST(setting_value AS BOOLEAN) END AS boolean_value,
       CASE WHEN data_type = 'TIMESTAMP' THEN TRY_CAST(setting_value AS TIMESTAMP) END AS timestamp_value,
       CASE WHEN data_type = 'STRING' THEN setting_value END AS string_value FROM settings""", "decimal_value")
_q("unmatched_documents", "fx_documents fx_queries", """
SELECT CAST(start_time AS DATE) AS usage_date, COUNT(*) AS documents,
       COUNT(*) FILTER (WHERE query_id NOT IN (SELECT query_id FROM fx_queries)) AS unmatched FROM fx_documents GROUP BY 1""")
_q("config_summary", "settings", "SELECT account, COUNT(*) AS settings_count, MAX(updated_at) AS last_updated FROM settings GROUP BY 1")
_q("date_series", "daily", """
SELECT service_type, CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS expected_date
FROM (SELECT service_type, MIN(usage_date) AS lo, MAX(usage_date) AS hi FROM daily GROUP BY 1)""")

# rollups and attribution
_q("function_summary", "function_summary", "SELECT * FROM function_summary", _FUNCTION_DOUBLES)
_q("model_comparison", "models", "SELECT * FROM models", _FUNCTION_DOUBLES + " median_credits p90_credits")
_q("function_daily_trends", "trends", "SELECT * FROM trends", "daily_credits")
_COST_DOUBLES = "credits_used cost_per_million_units cost_per_page"
_q("query_cost_analysis", "query_costs", "SELECT * FROM query_costs", _COST_DOUBLES)
_q("top_queries", "query_costs", "SELECT * FROM query_costs WHERE cost_rank <= 10", _COST_DOUBLES)
_q("user_spend_attribution", "attribution", "SELECT * FROM attribution", "credits_used credits_per_operation")


def _service_sum(service: str) -> str:
    return f"SUM(CASE WHEN service_type = '{service}' THEN credits_used ELSE 0 END)"


_q("user_spend_summary", "attribution", f"""
SELECT user_name, SUM(credits_used) AS total_credits_used, {_service_sum('Analyst')} AS analyst_credits_used,
       {_service_sum('Functions')} AS functions_credits_used, {_service_sum('Document Processing')} AS document_processing_credits_used,
       MIN(usage_date) AS first_usage_date, MAX(usage_date) AS last_usage_date, COUNT(DISTINCT usage_date) AS active_days,
       COUNT(DISTINCT service_type) AS services_used FROM attribution GROUP BY 1""",
   "total_credits_used analyst_credits_used functions_credits_used document_processing_credits_used")
_q("user_feature_usage", "attribution", f"""
SELECT user_name, service_type, feature_name, model_name, SUM(credits_used) AS total_credits_used,
       {big('SUM(operations)')} AS total_operations, MIN(usage_date) AS first_usage_date, MAX(usage_date) AS last_usage_date
FROM attribution GROUP BY 1, 2, 3, 4""", "total_credits_used")
_q("daily_summary", "daily", "SELECT * FROM daily", _USAGE_DOUBLES)
_q("cost_export", "export", "SELECT * FROM export", _EXPORT_DOUBLES)
_q("metering_ai_services", "metered", "SELECT * FROM metered", "total_credits compute_credits cloud_services_credits")

# snapshots, history, anomalies
for _key, _cte in (("snapshot_source", "features"), ("snapshot_source_repeated", "features_repeated")):
    _q(_key, _cte, f"SELECT {AS_OF} AS snapshot_date, * FROM {_cte} WHERE usage_date BETWEEN {AS_OF} - 2 AND {AS_OF}", _SNAPSHOT_DOUBLES)
_q("snapshot_job", "features", f"""
SELECT {AS_OF} AS snapshot_date, *, TIMESTAMP '2024-01-31 03:00:00' AS inserted_at FROM features WHERE usage_date BETWEEN {AS_OF} - 2 AND {AS_OF}""",
   _SNAPSHOT_DOUBLES)
_QUERIES["snapshot_published"] = _QUERIES["snapshot_job"]
_q("snapshot_backfill", "snapshots", "SELECT * FROM snapshots", _SNAPSHOT_DOUBLES)
_q("usage_history", "history", "SELECT * EXCLUDE (credits_wow_growth_raw), ROUND(credits_wow_growth_raw, 2) AS credits_wow_growth_pct FROM history",
   _EXPORT_DOUBLES + " credits_per_page credits_per_document credits_7d_ago credits_wow_growth_pct")
_q("usage_history_calendar", "history", f"""
SELECT a.date, a.service_type, a.total_credits, b.total_credits AS credits_7d_ago,
       ROUND({growth('a.total_credits', 'b.total_credits')}, 2) AS credits_wow_growth_pct
FROM history a LEFT JOIN history b ON a.service_type = b.service_type AND b.date = a.date - 7""",
   "total_credits credits_7d_ago credits_wow_growth_pct")
_ALERT_DOUBLES = "total_credits credits_7d_ago credits_14d_ago credits_7d_avg wow_growth_pct wow_credits_change two_week_growth_pct deviation_from_avg_pct"
_q("cost_anomalies", "anomalies", "SELECT * FROM anomalies", _ALERT_DOUBLES)
_q("cost_anomalies_refreshed", "account_anomalies", "SELECT * FROM account_anomalies", _ALERT_DOUBLES)
_q("cost_anomalies_configured", "configured_anomalies", "SELECT * FROM configured_anomalies", _ALERT_DOUBLES)
_q("sql_over_views", "anomalies export attribution", f"""
SELECT e.service_type, COUNT(*) AS days, SUM(e.total_credits) AS total_credits, COUNT(a.date) AS alerts, MAX(u.users) AS most_users_30d
FROM export e LEFT JOIN anomalies a ON a.date = e.date AND a.service_type = e.service_type AND a.alert_level IN ('HIGH', 'MEDIUM')
LEFT JOIN (SELECT d.service_type, d.date, COUNT(DISTINCT t.user_name) AS users
           FROM (SELECT x.service_type, x.date FROM export x JOIN (SELECT service_type, MIN(usage_date) AS first FROM attribution WHERE user_name IS NOT NULL GROUP BY 1) f
                 ON f.service_type = x.service_type AND x.date >= f.first) d
           LEFT JOIN attribution t ON t.service_type = d.service_type AND t.usage_date <= d.date AND t.usage_date > d.date - 30 GROUP BY 1, 2) u
ON u.service_type = e.service_type AND u.date = e.date
WHERE e.date >= DATE '2023-12-01' GROUP BY 1 HAVING SUM(e.total_credits) > 0""", "total_credits")
_q("model_credit_quantiles", "fx_functions", """
SELECT model_name, COUNT(*) AS records, COUNT(*) AS exact_records, TRUE AS median_credits_in_rank, TRUE AS p90_credits_in_rank, TRUE AS p99_credits_in_rank
FROM fx_functions WHERE CAST(usage_time AS DATE) BETWEEN DATE '2023-12-01' AND DATE '2023-12-31' AND model_name IS NOT NULL AND token_credits IS NOT NULL
GROUP BY 1""")
_q("cost_anomalies_calendar", "calendar_anomalies", "SELECT * FROM calendar_anomalies", _ALERT_DOUBLES)
_q("cost_anomalies_current", "account_alerts", "SELECT * FROM account_alerts", "total_credits credits_7d_ago wow_growth_pct wow_credits_change")
_q("cost_anomaly_summary", "account_anomalies", f"""
SELECT account, alert_level, COUNT(*) AS alert_count, COUNT(DISTINCT service_type) AS affected_services,
       {avg('CAST(wow_growth_pct AS DECIMAL(20,2))')} AS avg_growth_pct, MAX(wow_growth_pct) AS max_growth_pct,
       SUM(wow_credits_change) AS total_credits_change, MIN(date) AS first_occurrence, MAX(date) AS last_occurrence,
       STRING_AGG(DISTINCT service_type, ', ' ORDER BY service_type) AS services_list
FROM account_anomalies WHERE date >= {AS_OF} - 30 AND alert_level IN ('HIGH', 'MEDIUM', 'DECLINING') GROUP BY 1, 2""",
   "avg_growth_pct max_growth_pct total_credits_change")
_q("anomaly_status", "current_alerts", """
SELECT COUNT(*) AS active_anomalies, CASE WHEN COUNT(*) = 0 THEN 'No active anomalies detected'
       ELSE COUNT(*) || ' active anomalies detected' END AS current_status FROM current_alerts""")
_q("anomaly_top10", "current_alerts", """
SELECT date, service_type, total_credits, credits_7d_ago, wow_growth_pct, alert_level, alert_message, recommended_action
FROM current_alerts ORDER BY date DESC, priority_score DESC, wow_growth_pct DESC NULLS FIRST, service_type LIMIT 10""",
   "total_credits credits_7d_ago wow_growth_pct")
_q("anomaly_digest", "account_alerts", """
SELECT account, COUNT(*) AS alert_count, STRING_AGG(alert_message, '; ' ORDER BY date, service_type) AS alert_digest
FROM account_alerts GROUP BY 1""")

# forecasts and projections
_q("forecast_input", "series", "SELECT * FROM series", "y")
_BOUNDS = "forecast_credits lower_bound_credits upper_bound_credits"
_q("forecast_12m", "forecast", "SELECT * FROM forecast", _BOUNDS)
_q("linear_forecast", "account_line_3m", "SELECT * FROM account_line_3m", "forecast_credits")
_q("linear_forecast_monthly", "account_line", """
SELECT *, forecast_credits * 3.0::DOUBLE AS forecast_cost_usd FROM (
  SELECT account, CAST(date_trunc('month', date) AS DATE) AS month,
         CAST(SUM(CAST(CAST(forecast_credits AS VARCHAR) AS DECIMAL(28,12))) AS DOUBLE) AS forecast_credits FROM account_line GROUP BY 1, 2)""",
   "forecast_credits forecast_cost_usd")
_q("forecast_by_month", "forecast_months", "SELECT * FROM forecast_months", _BOUNDS)
_q("forecast_monthly", "forecast_months", """
SELECT *, forecast_credits * 3.0::DOUBLE AS forecast_cost_usd, lower_bound_credits * 3.0::DOUBLE AS lower_cost_usd,
       upper_bound_credits * 3.0::DOUBLE AS upper_cost_usd
FROM (SELECT month, CAST(SUM(forecast_credits) AS DOUBLE) AS forecast_credits, CAST(SUM(lower_bound_credits) AS DOUBLE) AS lower_bound_credits,
             CAST(SUM(upper_bound_credits) AS DOUBLE) AS upper_bound_credits FROM forecast_months GROUP BY 1)""",
   _BOUNDS + " forecast_cost_usd lower_cost_usd upper_cost_usd")
_SERVICES = ["Analyst", "Document Processing", "Fine-tuning", "Function Models", "Search"]
_MODELS = ["claude-3-haiku", "in-house-1", "llama3.1-405b", "llama3.1-70b", "mistral-7b"]
def _pivoted(column: str, value: str, names: list[str]) -> str:
    """One column per name, one for other names and one for none."""
    listed = ", ".join(f"'{n}'" for n in names)
    tests = {n: f"{column} = '{n}'" for n in names} | {"(other)": f"{column} NOT IN ({listed})", "(none)": f"{column} IS NULL"}
    return ", ".join(f'COALESCE(SUM(CASE WHEN {test} THEN {value} END), 0) AS "{n}"' for n, test in tests.items())


_EXTRA = ["(other)", "(none)"]
_q("forecast_pivot", "forecast_months", f"SELECT month, {_pivoted('service_type', 'forecast_credits', _SERVICES)} FROM forecast_months GROUP BY 1",
   "|".join(_SERVICES + _EXTRA))
_q("growth_projection", "projection", "SELECT * FROM projection", "projected_credits projected_users projected_cost_usd cost_per_user_usd growth_rate")
_q("growth_monthly_band", "band", "SELECT * FROM band", "projected_cost_usd lower_bound upper_bound cumulative_cost_usd")
_q("growth_cards", "band", """
SELECT *, total_cost * 0.1::DOUBLE AS variance_usd FROM (
  SELECT account, MAX(CASE WHEN month = 1 THEN projected_cost_usd END) AS month_1_cost,
         COALESCE(MAX(CASE WHEN month = 12 THEN projected_cost_usd END), 0) AS month_12_cost, MAX(cumulative_cost_usd) AS total_cost
  FROM band GROUP BY 1)""", "month_1_cost month_12_cost total_cost variance_usd")
_q("growth_scenarios", "fx_accounts", f"""
SELECT account, scenario, CAST(r AS DOUBLE) AS growth_rate, CAST(m AS INTEGER) AS month,
       credits * POW(1 + CAST(r AS DOUBLE), m) * 3.0::DOUBLE AS projected_cost_usd
FROM (SELECT account, {dbl('SUM(total_credits)')} AS credits FROM fx_accounts GROUP BY 1),
     (VALUES ('Conservative', 0.10), ('Moderate', 0.25), ('Aggressive', 0.50), ('Rapid', 1.00)) AS s(scenario, r), range(1, 13) AS t(m)""",
   "growth_rate projected_cost_usd")
_q("growth_two_driver", "account_base", """
SELECT *, projected_credits * 3.0::DOUBLE AS projected_cost_usd FROM (
  SELECT account, CAST(m AS INTEGER) AS month, service_type, base_users * POW(1.1::DOUBLE, m) AS projected_users,
         base_credits * POW(1.1::DOUBLE, m) * POW(1.05::DOUBLE, m) AS projected_credits FROM account_base, range(1, 7) AS t(m))""",
   "projected_users projected_credits projected_cost_usd")
_q("scale_scenarios", "scenarios", "SELECT * FROM scenarios",
   "user_multiplier usage_multiplier current_users current_monthly_cost projected_users projected_monthly_cost projected_annual_cost cost_per_user")
_q("budget_recommendation", "scenarios", """
SELECT *, upper_bound * 1.15::DOUBLE AS recommended_annual_budget, upper_bound * 1.15::DOUBLE / 12 AS recommended_monthly_budget
FROM (SELECT account, scenario, projected_annual_cost, confidence_score, projected_annual_cost * (1 - v) AS lower_bound,
             projected_annual_cost * (1 + v) AS upper_bound
      FROM (SELECT *, GREATEST(0.05::DOUBLE, 0.30::DOUBLE - CAST(confidence_score AS DOUBLE) / 100 * 0.25::DOUBLE) AS v FROM scenarios))""",
   "projected_annual_cost lower_bound upper_bound recommended_annual_budget recommended_monthly_budget")
_q("budget_capacity", "executive", """
SELECT account, cost_per_user, users_supported, used_budget, used_budget / 3.0::DOUBLE AS total_monthly_credits,
       used_budget / 50000 * 100 AS utilisation_pct, 50000 - used_budget AS remaining_budget
FROM (SELECT *, users_supported * cost_per_user AS used_budget
      FROM (SELECT account, cost_per_user_month AS cost_per_user,
                   CASE WHEN cost_per_user_month > 0 THEN CAST(FLOOR(50000 * 0.85::DOUBLE / cost_per_user_month) AS BIGINT) END AS users_supported
            FROM executive))""", "cost_per_user used_budget total_monthly_credits utilisation_pct remaining_budget")

# calculator analytics
_EXECUTIVE_DOUBLES = "total_credits avg_users avg_daily_credits monthly_credits monthly_cost annual_cost cost_per_user_month variance_pct lower_bound upper_bound"
_BREAKDOWN_DOUBLES = "total_credits avg_daily_users total_cost_usd pct_of_total monthly_cost_usd annual_cost_usd"
_q("data_maturity", "maturity", "SELECT * FROM maturity", "completeness")
_q("executive_summary", "executive", "SELECT * FROM executive", _EXECUTIVE_DOUBLES)
_q("executive_summary_overall", "executive_overall", "SELECT * FROM executive_overall", _EXECUTIVE_DOUBLES)
_q("service_breakdown", "breakdown", "SELECT * FROM breakdown", _BREAKDOWN_DOUBLES)
_q("service_breakdown_overall", "export", _breakdown("export", ""), _BREAKDOWN_DOUBLES)
_q("top_cost_drivers", "breakdown", """
SELECT account, driver_rank, service_type, total_credits, monthly_cost_usd, pct_of_total
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account ORDER BY total_credits DESC, service_type) AS driver_rank FROM breakdown)
WHERE driver_rank <= 3""", "total_credits monthly_cost_usd pct_of_total")
_q("rolling_30d", "rolling", "SELECT * FROM rolling", "total_credits credits_30d_total users_30d_avg cost_per_user_30d")
_q("rolling_30d_calendar", "fx_accounts", _rolling("RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW"),
   "total_credits credits_30d_total users_30d_avg cost_per_user_30d")
_q("latest_rolling_30d", "latest", "SELECT * FROM latest", "credits_30d_total users_30d_avg cost_per_user_30d cost_30d_usd cost_per_user_30d_usd")
_q("latest_rolling_totals", "latest", f"""
SELECT *, total_30d_credits * 3.0::DOUBLE AS total_30d_cost_usd,
       CASE WHEN avg_30d_users > 0 THEN total_30d_credits * 3.0::DOUBLE / avg_30d_users ELSE 0.0 END AS avg_cost_per_user_30d
FROM (SELECT account, {dbl('SUM(CAST(credits_30d_total AS DECIMAL(28,6)))')} AS total_30d_credits,
             {avg('CAST(users_30d_avg AS DECIMAL(28,9))')} AS avg_30d_users FROM latest GROUP BY 1)""",
   "total_30d_credits avg_30d_users total_30d_cost_usd avg_cost_per_user_30d")
_q("history_header", "fx_accounts", f"""
SELECT h.account, {dbl('credits')} AS total_credits, {dbl('credits')} * 3.0::DOUBLE AS total_cost_usd, avg_daily_users, avg_daily_credits
FROM (SELECT account, SUM(total_credits) AS credits, {avg('daily_unique_users')} AS avg_daily_users FROM fx_accounts GROUP BY 1) h
JOIN (SELECT account, {avg('day_credits')} AS avg_daily_credits
      FROM (SELECT account, date, SUM(total_credits) AS day_credits FROM fx_accounts GROUP BY 1, 2) GROUP BY 1) d ON h.account = d.account""",
   "total_credits total_cost_usd avg_daily_users avg_daily_credits")
_q("daily_trend", "export", "SELECT date, service_type, SUM(total_credits) AS total_credits FROM export GROUP BY 1, 2", "total_credits")
_q("credit_summary", "fx_accounts", f"""
SELECT *, total_credits / days_of_data AS avg_credits_per_day, total_credits / days_of_data * 30 AS est_credits_per_month,
       total_credits / days_of_data * 30 * 3.0::DOUBLE AS est_cost_per_month
FROM (SELECT account, service_type, {dbl('SUM(total_credits)')} AS total_credits, {avg('daily_unique_users')} AS avg_daily_users,
             MIN(date) AS start_date, MAX(date) AS end_date, date_diff('day', MIN(date), MAX(date)) + 1 AS days_of_data
      FROM fx_accounts GROUP BY 1, 2)""", "total_credits avg_daily_users avg_credits_per_day est_credits_per_month est_cost_per_month")
_q("user_totals", "attribution", f"""
SELECT SUM(credits_used) AS total_credits, {dbl('SUM(credits_used)')} * 3.0::DOUBLE AS total_cost_usd,
       COUNT(DISTINCT user_name) AS unique_users FROM attribution""", "total_credits total_cost_usd")
_q("top_users", "attribution", f"""
SELECT user_name, SUM(credits_used) AS credits_used, {dbl('SUM(credits_used)')} * 3.0::DOUBLE AS cost_usd
FROM attribution WHERE user_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""", "credits_used cost_usd")
_LEAVES = """SELECT user_name, service_type, feature_name, COALESCE(model_name, '(none)') AS model_name, SUM(credits_used) AS credits_used
FROM attribution WHERE user_name IS NOT NULL GROUP BY 1, 2, 3, 4"""
_q("user_hierarchy", "attribution", _LEAVES, "credits_used")
_q("user_hierarchy_levels", "attribution", f"""
SELECT user_name, service_type, feature_name, model_name, SUM(credits_used) AS credits_used,
       {big('GROUPING(user_name, service_type, feature_name, model_name)')} AS summed_levels
FROM ({_LEAVES}) GROUP BY ROLLUP (user_name, service_type, feature_name, model_name)""", "credits_used")
_q("user_drilldown", "attribution", f"SELECT *, {dbl('credits_used')} * 3.0::DOUBLE AS cost_usd FROM ({_LEAVES})", "credits_used cost_usd")
_q("function_overview", "function_summary", f"""
SELECT COUNT(DISTINCT function_name) AS functions_used, COUNT(DISTINCT model_name) AS models_used, {big('SUM(call_count)')} AS total_calls,
       {dbl('SUM(total_credits)')} AS total_credits, {dbl('SUM(total_credits)')} * 3.0::DOUBLE AS total_cost_usd FROM function_summary""",
   "total_credits total_cost_usd")
_q("top_functions", "function_summary", f"""
SELECT function_name, {big('SUM(call_count)')} AS call_count, SUM(total_credits) AS total_credits, {big('SUM(total_tokens)')} AS total_tokens,
       {big('SUM(serverless_calls)')} AS serverless_calls, {big('SUM(compute_calls)')} AS compute_calls,
       {dbl('SUM(total_credits)')} * 3.0::DOUBLE AS cost_usd FROM function_summary GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""", "total_credits cost_usd")
_q("top_function_models", "function_summary", """
SELECT function_name, model_name, call_count, total_credits, total_tokens, avg_credits_per_call, avg_tokens_per_call,
       cost_per_million_tokens, serverless_calls, compute_calls FROM function_summary
ORDER BY total_credits DESC, function_name, model_name NULLS FIRST LIMIT 50""", _FUNCTION_DOUBLES)
_q("top_models", "models", f"""
SELECT model_name, functions_used, total_calls, total_credits, total_tokens, avg_credits_per_call, cost_per_million_tokens,
       median_credits, p90_credits, {dbl('total_credits')} * 3.0::DOUBLE AS cost_usd, cost_per_million_tokens * 3.0::DOUBLE AS cost_per_million_usd
FROM models ORDER BY total_credits DESC, model_name LIMIT 20""",
   "total_credits avg_credits_per_call cost_per_million_tokens median_credits p90_credits cost_usd cost_per_million_usd")
_q("recent_trends", "trends", f"""
SELECT usage_date, function_name, model_name, daily_credits, daily_tokens, serverless_calls, compute_calls FROM trends
WHERE usage_date >= {AS_OF} - 30 ORDER BY usage_date DESC, daily_credits DESC, function_name, model_name NULLS FIRST""", "daily_credits")
_q("function_model_matrix", "function_summary",
   f"SELECT function_name, {_pivoted('model_name', 'total_credits', _MODELS)} FROM function_summary GROUP BY 1", "|".join(_MODELS + _EXTRA))
_q("function_daily", "trends", f"""
SELECT usage_date, function_name, SUM(daily_credits) AS daily_credits, {big('SUM(daily_tokens)')} AS daily_tokens
FROM trends GROUP BY 1, 2""", "daily_credits")
_q("function_model_detail", "function_summary", f"""
SELECT function_name, model_name, call_count, total_credits, {dbl('total_credits')} * 3.0::DOUBLE AS cost_usd, total_tokens,
       cost_per_million_tokens * 3.0::DOUBLE AS cost_per_million_usd, avg_tokens_per_call, serverless_calls, compute_calls
FROM function_summary""", "total_credits cost_usd cost_per_million_usd avg_tokens_per_call")
_q("rate_check", "fx_accounts", f"""
SELECT *, CASE WHEN expected_rate IS NULL THEN 'No baseline' WHEN ABS(observed_rate - expected_rate) / expected_rate < 0.5 THEN 'Within range'
          ELSE 'Verify' END AS status
FROM (SELECT *, CASE WHEN service_type LIKE '%Document%' AND NOT service_type LIKE '%Analyst%' THEN rate_per_operation * 1000 ELSE rate_per_operation END AS observed_rate,
             CASE WHEN service_type LIKE '%Analyst%' THEN 0.067::DOUBLE WHEN service_type LIKE '%Document%' THEN 1.915::DOUBLE END AS expected_rate,
             CASE WHEN service_type LIKE '%Analyst%' THEN 'messages' WHEN service_type LIKE '%Document%' THEN 'pages' ELSE 'operations' END AS metric
      FROM (SELECT account, service_type, SUM(total_credits) AS total_credits, {big('SUM(total_operations)')} AS total_operations,
                   {ratio('SUM(total_credits)', 'SUM(total_operations)')} AS rate_per_operation
            FROM fx_accounts GROUP BY 1, 2 HAVING SUM(total_operations) > 0))""", "total_credits rate_per_operation observed_rate expected_rate")
_q("rate_card_join", "function_summary", """
WITH m(model_name, input_rate, output_rate) AS (VALUES
  ('claude-4-sonnet', 3.0, 15.0), ('claude-3-7-sonnet', 3.0, 15.0), ('claude-3-5-sonnet', 3.0, 15.0), ('claude-3-5-haiku', 1.0, 5.0),
  ('claude-3-opus', 15.0, 75.0), ('claude-3-sonnet', 3.0, 15.0), ('claude-3-haiku', 0.25, 1.25), ('llama3.1-405b', 3.0, 3.0),
  ('llama3.1-70b', 0.4, 0.4), ('llama3.1-8b', 0.1, 0.1), ('llama3-70b', 0.4, 0.4), ('llama3-8b', 0.1, 0.1), ('deepseek-r1', 0.55, 2.19),
  ('mistral-large2', 2.0, 6.0), ('mistral-large', 2.0, 6.0), ('mixtral-8x7b', 0.15, 0.15), ('mistral-7b', 0.1, 0.1)),
f(function_name, function_rate) AS (VALUES ('SENTIMENT', 0.056), ('SUMMARIZE', 0.056), ('TRANSLATE', 0.056), ('EXTRACT_ANSWER', 0.056),
  ('AI_EXTRACT', 0.15), ('AI_SENTIMENT', 0.3), ('EMBED_TEXT_768', 0.014), ('EMBED_TEXT_1024', 0.014), ('EMBED_IMAGE_1024', 0.14)),
p(function_name, model_name, pair_input, pair_output) AS (VALUES ('AI_EXTRACT', 'mistral-large', 2.0, 6.0), ('AI_EMBED', 'e5-base-v2', 0.014, 0.014),
  ('AI_EMBED', 'multilingual-e5-large', 0.014, 0.014))
SELECT *, CASE WHEN rate_low IS NULL THEN 'No published rate' WHEN CAST(total_credits AS DOUBLE) < expected_credits_low THEN 'Below published rate'
       WHEN CAST(total_credits AS DOUBLE) > expected_credits_high THEN 'Above published rate' ELSE 'Within published rate' END AS rate_status
FROM (SELECT s.function_name, s.model_name, total_tokens, total_credits, cost_per_million_tokens,
             CAST(COALESCE(pair_input, function_rate, input_rate) AS DOUBLE) AS rate_low, CAST(COALESCE(pair_output, function_rate, output_rate) AS DOUBLE) AS rate_high,
             CAST(total_tokens AS DOUBLE) / 1000000 * CAST(COALESCE(pair_input, function_rate, input_rate) AS DOUBLE) AS expected_credits_low,
             CAST(total_tokens AS DOUBLE) / 1000000 * CAST(COALESCE(pair_output, function_rate, output_rate) AS DOUBLE) AS expected_credits_high
      FROM function_summary s LEFT JOIN m ON s.model_name = m.model_name LEFT JOIN f ON s.function_name = f.function_name
      LEFT JOIN p ON s.function_name = p.function_name AND s.model_name = p.model_name)""",
   "total_credits cost_per_million_tokens rate_low rate_high expected_credits_low expected_credits_high")
_q("request_baseline", "baseline", "SELECT * FROM baseline", "total_credits users_in_env requests_per_day cost_per_request")
_q("baseline_checks", "baseline", """
SELECT account, service_type, rate_deviation_pct, CASE WHEN rate_deviation_pct < 5 THEN 'matches' WHEN rate_deviation_pct < 20 THEN 'acceptable'
       WHEN rate_deviation_pct IS NOT NULL THEN 'deviates' ELSE 'no published rate' END AS rate_status,
       total_operations = 0 AS has_no_operations, cost_per_request > 10 AS has_high_request_cost,
       CAST(days_with_data AS DOUBLE) / 30 * 100 AS coverage_pct, CAST(days_with_data AS DOUBLE) / 30 * 100 < 30 AS has_low_coverage
FROM (SELECT *, CASE WHEN service_type = 'Analyst' THEN ABS((cost_per_request / 3.0::DOUBLE - 0.067::DOUBLE) / 0.067::DOUBLE * 100) END AS rate_deviation_pct
      FROM baseline)""", "rate_deviation_pct coverage_pct")
_q("persona_costs", "personas", "SELECT * FROM personas", "cost_per_request cost_per_user_month total_monthly_cost")
_q("persona_totals", "personas", """
SELECT *, CASE WHEN total_users > 0 THEN total_monthly_cost / total_users ELSE 0.0 END AS avg_cost_per_user FROM (
  SELECT account, CAST(SUM(users) AS BIGINT) AS total_users, CAST(SUM(requests_per_month * users) AS BIGINT) AS total_monthly_requests,
         CAST(SUM(CAST(total_monthly_cost AS DECIMAL(38,9))) AS DOUBLE) AS total_monthly_cost FROM personas GROUP BY 1)""",
   "total_monthly_cost avg_cost_per_user")
_q("cost_per_user_calculator", "fx_accounts", f"""
SELECT * EXCLUDE (total), credits_per_user_month * 3.0::DOUBLE AS cost_per_user_month,
       CASE WHEN total > 0 THEN credits_per_user_month / total * 100 ELSE 0.0 END AS pct_of_user_cost
FROM (SELECT *, CAST(SUM(CAST(credits_per_user_month AS DECIMAL(28,9))) OVER (PARTITION BY account) AS DOUBLE) AS total
      FROM (SELECT *, credits_per_operation * 440::DOUBLE AS credits_per_user_month
            FROM (SELECT account, service_type, {ratio('SUM(total_credits)', 'SUM(total_operations)')} AS credits_per_operation
                  FROM fx_accounts GROUP BY 1, 2)))""", "credits_per_operation credits_per_user_month cost_per_user_month pct_of_user_cost")
_q("summary_long", "executive", "".join(
    (" UNION ALL " if i else "") + f"SELECT account, '{name}' AS metric, CAST({column} AS DOUBLE) AS value FROM executive"
    for i, (name, column) in enumerate([
        ("Analysis Period (days)", "days"), ("Monthly Cost Estimate", "monthly_cost"), ("Annual Cost Estimate", "annual_cost"),
        ("Lower Bound (Annual)", "lower_bound"), ("Upper Bound (Annual)", "upper_bound"), ("Average Daily Users", "avg_users"),
        ("Cost per User/Month", "cost_per_user_month"), ("Data Confidence", "confidence_score"),
    ])), "value")
_YEAR = "(SELECT SUM(POW(1.25::DOUBLE, m)) FROM range(1, 13) AS t(m))"
_q("summary_report", "executive", f"""
SELECT *, projected_annual_cost_usd * (1 - 0.1::DOUBLE) AS lower_bound_usd, projected_annual_cost_usd * (1 + 0.1::DOUBLE) AS upper_bound_usd,
       projected_annual_cost_usd / 12 AS avg_monthly_cost_usd
FROM (SELECT account, days, service_count, total_credits, avg_users, total_credits * 3.0::DOUBLE AS total_cost_usd,
             avg_daily_credits * 3.0::DOUBLE AS avg_daily_cost_usd, total_credits * 3.0::DOUBLE * {_YEAR} AS projected_annual_cost_usd FROM executive)""",
   "total_credits avg_users total_cost_usd avg_daily_cost_usd projected_annual_cost_usd lower_bound_usd upper_bound_usd avg_monthly_cost_usd")
_q("benchmark_band", "fx_accounts", f"""
SELECT account, service_type, avg_users, credits_per_user_month, low, typical, high,
       CASE WHEN low IS NULL THEN 'no benchmark' WHEN credits_per_user_month < low THEN 'below low' WHEN credits_per_user_month < typical THEN 'low to typical'
            WHEN credits_per_user_month <= high THEN 'typical to high' ELSE 'above high' END AS band
FROM (SELECT *, CASE WHEN avg_users > 0 THEN c / d * 30 / avg_users ELSE 0.0 END AS credits_per_user_month
      FROM (SELECT account, service_type, {dbl('SUM(total_credits)')} AS c, COUNT(DISTINCT date) AS d, {avg('daily_unique_users')} AS avg_users
            FROM fx_accounts GROUP BY 1, 2))
LEFT JOIN (VALUES ('Analyst', 1.0, 3.0, 8.0), ('Functions', 0.5, 2.0, 10.0), ('Search', 0.1, 0.5, 2.0), ('Document Legacy', 0.2, 1.0, 5.0))
     AS b(service, low, typical, high) ON service_type = service""", "avg_users credits_per_user_month low typical high")

# data quality


def _missing(source: str, group: str) -> str:
    return f"""
SELECT {group}, COUNT(*) FILTER (WHERE x.usage_date IS NULL) AS missing_count,
       COALESCE(STRING_AGG(CAST(d AS VARCHAR), ', ' ORDER BY d) FILTER (WHERE x.usage_date IS NULL), '') AS missing_dates
FROM (SELECT DISTINCT {group} FROM {source}) g
CROSS JOIN (SELECT {AS_OF} - 30 + CAST(i AS INTEGER) AS d FROM range(0, 31) AS t(i))
LEFT JOIN (SELECT DISTINCT {group} AS k, usage_date FROM {source}) x ON x.k = g.{group} AND x.usage_date = d
GROUP BY 1"""


_q("dq_missing_dates", "account_days", _missing("account_days", "account"))
_q("dq_missing_dates_service", "daily", _missing("daily", "service_type"))
_q("dq_stale_services", "account_days", f"""
SELECT account, service_type, MAX(usage_date) AS last_data_date, date_diff('day', MAX(usage_date), {AS_OF}) AS days_since_last_data
FROM account_days GROUP BY 1, 2 HAVING date_diff('day', MAX(usage_date), {AS_OF}) > 2""")
_q("dq_null_counts", "daily", """
SELECT COUNT(*) FILTER (WHERE service_type IS NULL) AS null_service_type, COUNT(*) FILTER (WHERE total_credits IS NULL) AS null_total_credits,
       COUNT(*) FILTER (WHERE daily_unique_users IS NULL) AS null_daily_users, COUNT(*) FILTER (WHERE total_operations IS NULL) AS null_operations
FROM daily""")
_q("dq_ratio_accuracy", "daily", """
SELECT COUNT(*) AS error_count, SUM(total_credits) AS total_credits_affected FROM daily
WHERE daily_unique_users > 0 AND ABS(credits_per_user - CAST(total_credits AS DOUBLE) / daily_unique_users) > 0.01""", "total_credits_affected")
_q("dq_sum_consistency", "daily export", f"""
SELECT a AS summary_credits, b AS export_credits, ABS(a - b) AS difference,
       CASE WHEN ABS(a - b) < 0.01 THEN 'PASS' ELSE 'FAIL - Views out of sync' END AS status
FROM (SELECT (SELECT SUM(total_credits) FROM daily WHERE usage_date >= {AS_OF} - 30) AS a,
             (SELECT SUM(total_credits) FROM export WHERE date >= {AS_OF} - 30) AS b)""", "summary_credits export_credits difference")
_q("dq_value_ranges", "daily", """
SELECT COUNT(*) FILTER (WHERE total_credits < 0) AS negative_credits, COUNT(*) FILTER (WHERE total_credits > 10000) AS extremely_high_credits,
       COUNT(*) FILTER (WHERE daily_unique_users < 0) AS negative_users, COUNT(*) FILTER (WHERE daily_unique_users > 10000) AS extremely_high_users,
       COUNT(*) FILTER (WHERE total_operations < 0) AS negative_operations FROM daily""")
_q("dq_date_validity", "account_days", f"""
SELECT account, COUNT(*) FILTER (WHERE usage_date > {AS_OF}) AS future_dates, COUNT(*) FILTER (WHERE usage_date < DATE '2020-01-01') AS dates_too_old,
       MIN(usage_date) AS earliest_date, MAX(usage_date) AS latest_date FROM account_days GROUP BY 1""")
_q("dq_null_counts_faulty", "faulty_days", """
SELECT account, COUNT(*) FILTER (WHERE service_type IS NULL) AS null_service_type, COUNT(*) FILTER (WHERE total_credits IS NULL) AS null_total_credits,
       COUNT(*) FILTER (WHERE daily_unique_users IS NULL) AS null_daily_users, COUNT(*) FILTER (WHERE total_operations IS NULL) AS null_operations
FROM faulty_days GROUP BY 1""")
_OFF = "daily_unique_users > 0 AND ABS(credits_per_user - CAST(total_credits AS DOUBLE) / daily_unique_users) > 0.01"
_q("dq_ratio_accuracy_faulty", "faulty_days", f"""
SELECT account, COUNT(*) FILTER (WHERE {_OFF}) AS error_count, SUM(total_credits) FILTER (WHERE {_OFF}) AS total_credits_affected
FROM faulty_days GROUP BY 1""", "total_credits_affected")
_q("dq_value_ranges_faulty", "faulty_days", """
SELECT account, COUNT(*) FILTER (WHERE total_credits < 0) AS negative_credits, COUNT(*) FILTER (WHERE total_credits > 10000) AS extremely_high_credits,
       COUNT(*) FILTER (WHERE daily_unique_users < 0) AS negative_users, COUNT(*) FILTER (WHERE daily_unique_users > 10000) AS extremely_high_users,
       COUNT(*) FILTER (WHERE total_operations < 0) AS negative_operations FROM faulty_days GROUP BY 1""")
_q("dq_date_validity_faulty", "faulty_days", f"""
SELECT account, COUNT(*) FILTER (WHERE usage_date > {AS_OF}) AS future_dates, COUNT(*) FILTER (WHERE usage_date < DATE '2020-01-01') AS dates_too_old,
       MIN(usage_date) AS earliest_date, MAX(usage_date) AS latest_date FROM faulty_days GROUP BY 1""")
_q("dq_sum_consistency_faulty", "faulty_days", f"""
SELECT a AS summary_credits, b AS export_credits, ABS(a - b) AS difference,
       CASE WHEN ABS(a - b) < 0.01 THEN 'PASS' ELSE 'FAIL - Views out of sync' END AS status
FROM (SELECT (SELECT SUM(total_credits) FROM account_days WHERE usage_date >= {AS_OF} - 30) AS a,
             (SELECT SUM(total_credits) FROM faulty_days WHERE usage_date >= {AS_OF} - 30) AS b)""", "summary_credits export_credits difference")
_q("dq_score_faulty", "faulty_account_facts", f"SELECT * EXCLUDE (overall) FROM ({_score('faulty_account_facts', 'account')})", "completeness_score overall_quality_score")
_q("dq_unknown_services", "fx_uploaded", """
SELECT account, service_type, COUNT(*) AS occurrence_count FROM fx_uploaded
WHERE service_type NOT IN ('Analyst', 'Search', 'Functions', 'Document Processing', 'Fine-tuning', 'Search Serving', 'Document Legacy', 'Function Models')
GROUP BY 1, 2""")
_q("dq_duplicates", "fx_uploaded", """
SELECT date AS usage_date, service_type, COUNT(*) AS duplicate_count FROM fx_uploaded GROUP BY 1, 2 HAVING COUNT(*) > 1""")
_q("dq_score", "uploaded_facts", f"SELECT * EXCLUDE (overall) FROM ({_score('uploaded_facts', 'account')})", "completeness_score overall_quality_score")
_q("dq_score_overall", "facts", f"SELECT * EXCLUDE (overall) FROM ({_score('facts', '')})", "completeness_score overall_quality_score")
for _key, _cte in (("dq_recommendation", "uploaded_facts"), ("dq_recommendation_faulty", "faulty_account_facts")):
    _q(_key, _cte, f"""
SELECT account, CASE WHEN 31 - covered_days > 5 THEN 'Investigate missing dates - possible data pipeline issue'
       WHEN ratio_errors > 0 THEN 'Fix calculation errors in views' WHEN negative_credits > 0 THEN 'Investigate negative credit values'
       ELSE 'No critical issues detected' END AS recommendation FROM {_cte}""")
for _suffix, _cte in (("", "checks"), ("_faulty", "faulty_checks")):
    _q("check_results" + _suffix, _cte, f"SELECT * FROM {_cte}", "execution_time_ms")
def _view_checks(daily: str, checks: str, faulty: bool) -> str:
    rows = []
    for number, (name, relation, day) in enumerate((
        ("analyst_detail", "(SELECT CAST(start_time AS DATE) AS usage_date FROM fx_analyst WHERE start_time >= " + START + ")", "usage_date"),
        ("search_detail", "(SELECT * FROM fx_search WHERE usage_date >= " + START + ")", "usage_date"), ("daily_summary", daily, "usage_date"),
        ("user_spend_attribution", "attribution", "usage_date"), ("usage_history", "history", "date"), ("usage_forecast", "forecast", "forecast_date"),
    ), 1):
        if faulty and name in ("search_detail", "usage_history"):
            rows.append(f"SELECT {number} AS test_number, 'Compilation' AS test_category, '{name} can be read' AS test_name, 'FAIL' AS test_status, 'Error' AS test_message")
            continue
        rows.append(f"""
SELECT {number} AS test_number, 'Compilation' AS test_category, '{name} can be read' AS test_name, 'PASS' AS test_status,
       'View accessible, returned ' || COUNT(*) || ' rows from ' || MIN({day}) || ' to ' || MAX({day})
       || CASE WHEN COUNT(*) > COUNT({day}) THEN ', ' || (COUNT(*) - COUNT({day})) || ' without a date' ELSE '' END AS test_message FROM {relation}""")
    rows.append(f"SELECT test_number, test_category, test_name, test_status, test_message FROM {checks}")
    return f"SELECT *, TRUE AS timed FROM ({' UNION ALL '.join(rows)})"


_q("check_results_views", "fx_analyst fx_search attribution history forecast checks", _view_checks("daily", "checks", False))
_q("check_results_views_faulty", "fx_analyst attribution forecast faulty_checks", _view_checks("faulty_days", "faulty_checks", True))
_q("check_results_stored", "checks", "SELECT * FROM checks", "execution_time_ms")
for _suffix, _cte in (("", "checks"), ("_faulty", "faulty_checks")):
    _q("check_summary" + _suffix, _cte, f"""
SELECT test_category, COUNT(*) AS total_tests, COUNT(*) FILTER (WHERE test_status = 'PASS') AS passed,
       COUNT(*) FILTER (WHERE test_status = 'FAIL') AS failed, COUNT(*) FILTER (WHERE test_status = 'WARN') AS warnings,
       ROUND({avg('execution_time_ms')}, 2) AS avg_exec_time_ms FROM {_cte} GROUP BY 1""", "avg_exec_time_ms")
for _suffix, _cte in (("", "checks"), ("_faulty", "faulty_checks")):
    _q("check_overall" + _suffix, _cte, f"""
SELECT CASE WHEN COUNT(*) FILTER (WHERE test_status = 'FAIL') = 0 THEN 'ALL TESTS PASSED - Deployment validated successfully'
       ELSE COUNT(*) FILTER (WHERE test_status = 'FAIL') || ' TEST(S) FAILED - Review failures above' END AS overall_status,
       COUNT(*) AS total_tests, COUNT(*) FILTER (WHERE test_status = 'PASS') AS passed,
       COUNT(*) FILTER (WHERE test_status = 'FAIL') AS failed, COUNT(*) FILTER (WHERE test_status = 'WARN') AS warnings FROM {_cte}""")
_q("export_stats", "export", """
SELECT COUNT(*) AS total_rows, MIN(date) AS earliest_date, MAX(date) AS latest_date, date_diff('day', MIN(date), MAX(date)) AS days_of_history,
       COUNT(DISTINCT service_type) AS service_count FROM export""")
_q("export_service_stats", "export", f"""
SELECT service_type, COUNT(DISTINCT date) AS days_with_data, ROUND(SUM(total_credits), 8) AS total_credits,
       ROUND({avg('daily_unique_users')}, 2) AS avg_daily_users,
       ROUND({avg('CAST(credits_per_operation AS DECIMAL(28,12))')}, 8) AS avg_cost_per_operation FROM export GROUP BY 1""",
   "total_credits avg_daily_users avg_cost_per_operation")
_q("export_recent", "export", f"""
SELECT date, service_type, ROUND(total_credits, 8) AS total_credits, total_operations FROM export WHERE date >= {AS_OF} - 7""", "total_credits")


def _covered(service: str, cte: str, time: str, user: str) -> str:
    return (f"SELECT '{service}' AS service, COUNT(*) AS records, CAST(MIN({time}) AS TIMESTAMP) AS earliest, "
            f"CAST(MAX({time}) AS TIMESTAMP) AS latest, {user} AS records_with_user FROM {cte}")


_q("source_coverage", "fx_analyst fx_search fx_serving fx_functions fx_legacy fx_documents fx_tuning", " UNION ALL ".join([
    _covered("Analyst", "fx_analyst", "start_time", "COUNT(username)"), _covered("Search", "fx_search", "usage_date", "0"),
    _covered("Search Serving", "fx_serving", "start_time", "0"), _covered("Functions", "fx_functions", "usage_time", "COUNT(user_id)"),
    _covered("Document Legacy", "fx_legacy", "start_time", "0"), _covered("Document Processing", "fx_documents", "start_time", "0"),
    _covered("Fine-tuning", "fx_tuning", "start_time", "0"),
]))

# further reports
_RECONCILED = f"""
SELECT COALESCE(d.usage_date, m.usage_date) AS usage_date, COALESCE(d.c, 0) AS monitored_credits, COALESCE(m.c, 0) AS metered_credits,
       COALESCE(d.c, 0) - COALESCE(m.c, 0) AS difference
FROM (SELECT usage_date, SUM(total_credits) AS c FROM daily WHERE usage_date >= {AS_OF} - 30 GROUP BY 1) d
FULL OUTER JOIN (SELECT usage_date, SUM(total_credits) AS c FROM metered WHERE usage_date >= {AS_OF} - 30 GROUP BY 1) m ON d.usage_date = m.usage_date"""
_q("metering_reconcile", "daily metered", _RECONCILED, "monitored_credits metered_credits difference")
_q("metering_totals", "daily metered", f"""
SELECT 'Monitoring' AS source, (SELECT SUM(total_credits) FROM daily WHERE usage_date >= {AS_OF} - 30) AS credits
UNION ALL SELECT 'Metering', (SELECT SUM(total_credits) FROM metered WHERE usage_date >= {AS_OF} - 30)""", "credits")
_q("weekly_rollup", "export", f"""
SELECT CAST(date_trunc('week', date) AS DATE) AS week, service_type, SUM(total_credits) AS weekly_credits, {avg('daily_unique_users')} AS avg_users
FROM export GROUP BY 1, 2""", "weekly_credits avg_users")
_q("service_activity", "daily", """
SELECT service_type, MIN(usage_date) AS first_date, MAX(usage_date) AS last_date, SUM(total_credits) AS total_credits,
       COUNT(DISTINCT usage_date) AS days_active FROM daily GROUP BY 1""", "total_credits")
_q("failed_queries", "fx_queries", """
SELECT query_id, user_name, start_time, query_text, error_code, error_message FROM fx_queries
WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND error_code IS NOT NULL""")
_q("slow_queries", "fx_queries", """
SELECT query_id, query_text, total_elapsed_time, bytes_scanned, partitions_scanned FROM fx_queries
WHERE query_text ILIKE '%v_1-urgent%' AND start_time >= TIMESTAMP '2024-01-29 00:00:00'""")
_q("function_cost_monthly", "fx_functions", f"""
SELECT *, {cents('CAST(total_credits AS DOUBLE) * 3.0::DOUBLE')} AS estimated_cost_usd FROM (
  SELECT CAST(date_trunc('month', usage_time) AS DATE) AS month, model_name, {big('SUM(tokens)')} AS total_tokens, SUM(token_credits) AS total_credits
  FROM fx_functions WHERE function_name = 'TRANSLATE' AND usage_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 MONTH GROUP BY 1, 2)""",
   "total_credits estimated_cost_usd")
_q("function_cost_daily", "fx_functions", f"""
SELECT *, {cents('CAST(daily_credits AS DOUBLE) * 3.0::DOUBLE')} AS daily_cost_usd FROM (
  SELECT CAST(usage_time AS DATE) AS usage_date, COUNT(*) AS call_count, SUM(token_credits) AS daily_credits
  FROM fx_functions WHERE function_name = 'TRANSLATE' AND usage_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1)""",
   "daily_credits daily_cost_usd")
_q("cost_share_estimate", "export", f"""
SELECT date, service_type, total_credits,
       CASE WHEN service_type = 'Functions' THEN CAST(total_credits AS DOUBLE) * 0.15::DOUBLE ELSE 0.0 END AS estimated_share_credits,
       {cents('CAST(total_credits AS DOUBLE) * 3.0::DOUBLE')} AS total_cost_usd FROM export""",
   "total_credits estimated_share_credits total_cost_usd")
_q("cost_sentence", "export", f"""
SELECT *, 'Service: ' || service_type || ' consumed ' || CAST(CAST(total_credits AS DECIMAL(38,12)) AS VARCHAR) || ' credits costing $' || CAST(total_cost_usd AS VARCHAR) AS summary
FROM (SELECT service_type, total_credits, CAST(ROUND(total_credits * 3, 2) AS DECIMAL(36,2)) AS total_cost_usd
      FROM (SELECT service_type, SUM(total_credits) AS total_credits FROM export WHERE date >= {AS_OF} - 30 GROUP BY 1))""",
   "total_credits total_cost_usd")
_q("text_chunks", "", """
SELECT doc_id, i + 1 AS chunk_num, substr(text, i * 4000 + 1, 4000) AS text_chunk
FROM (SELECT doc_id, text, UNNEST(range(0, (length(text) + 3999) // 4000)) AS i FROM documents)""")
_q("non_ascii_docs", "", "SELECT * FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]')")
_q("distinct_services", "daily", "SELECT DISTINCT service_type FROM daily")
_q("stream_daily_usage", "", f"""
SELECT CAST(ts AS DATE) AS usage_date, event_type AS service_type, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users, {big(f'SUM({EVENT_K})')} AS total_operations,
       SUM(CAST(value / 100 AS {MONEY})) AS total_credits FROM events GROUP BY 1, 2""", "total_credits")


_q("forecast_seasonal", "account_smoothed", f"""
SELECT account, service_type, last_day + CAST(h AS INTEGER) AS forecast_date, GREATEST(0.0, v) AS forecast_credits,
       GREATEST(0.0, v - w) AS lower_bound_credits, GREATEST(0.0, v + w) AS upper_bound_credits, alpha, beta, gamma, 'OK' AS status
FROM (SELECT *, level + h * trend + season[1 + (CAST(h AS INTEGER) - 1) % 7] AS v, 1.96 * sigma * SQRT(CAST(1 AS DOUBLE) + ({seasonal.widening()})) AS w
      FROM (SELECT s.*, first_day + CAST(len(ys) - 1 AS INTEGER) AS last_day, CAST(unnest(range(1, 61)) AS DOUBLE) AS h
            FROM account_smoothed s JOIN account_arrays a USING (account, service_type)))
UNION ALL
SELECT account, service_type, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'TOO_SHORT' FROM account_arrays WHERE len(ys) < 21""")
_q("forecast_backtest", "account_errors", """
SELECT account, service_type, model, days, mean_absolute_error, mean_error,
       ROW_NUMBER() OVER (PARTITION BY account, service_type ORDER BY mean_absolute_error, place) = 1 AS best
FROM (SELECT account, service_type, place, model, COUNT(*) AS days, CAST(SUM(ABS(off)) AS DOUBLE) / COUNT(*) AS mean_absolute_error,
             CAST(SUM(off) AS DOUBLE) / COUNT(*) AS mean_error FROM account_errors GROUP BY 1, 2, 3, 4)""")
_q("active_users_sliding", "attribution", f"""
WITH active AS (
  SELECT DISTINCT unnest([service_type, 'All']) AS service_type, user_name AS u, usage_date AS d FROM attribution WHERE user_name IS NOT NULL
), calendar AS (
  SELECT service_type, CAST(unnest(generate_series(MIN(d), {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS day FROM active WHERE d <= {AS_OF} GROUP BY 1
)
SELECT c.service_type, c.day AS usage_date, COUNT(DISTINCT u) FILTER (d = c.day) AS users_1d,
       COUNT(DISTINCT u) FILTER (d > c.day - 7) AS users_7d, COUNT(DISTINCT u) AS users_30d
FROM calendar c LEFT JOIN active a ON a.service_type = c.service_type AND a.d <= c.day AND a.d > c.day - 30 GROUP BY 1, 2""")

_q("stream_daily_usage_sketched", "", f"""
SELECT CAST(ts AS DATE) AS usage_date, event_type AS service_type, COUNT(*) AS events, {big(f'SUM({EVENT_K})')} AS total_operations,
       SUM(CAST(value / 100 AS {MONEY})) AS total_credits, COUNT(DISTINCT user_id) AS exact_users, TRUE AS estimate_within_five_errors
FROM events GROUP BY 1, 2""", "total_credits")


def _presented(sql: str, doubles: str) -> str:
    """DECIMAL results as DOUBLE."""
    if not doubles:
        return f"SELECT * FROM ({sql})"
    names = doubles.split("|") if "|" in doubles else doubles.split()
    replaced = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in names)
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})"


def statements() -> dict[str, str]:
    return {key: _with(deps, _presented(sql, doubles)) for key, (deps, sql, doubles) in _QUERIES.items()}
