"""Usage tables derived from the driver's test tables.

All rows of the base tables are used. Dates of orders and line items are folded onto the 90 days before the fixed clock.
"""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..sources.telemetry import Telemetry

AS_OF = datetime(2024, 1, 31)
LOOKBACK_DAYS = 90
MONEY = "DECIMAL(18,6)"


# Declared, so that no job reads file footers to find the columns out.
BASE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
        "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"
    ),
    "pages": "page_id BIGINT, url STRING, html STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str) -> str:
    return f"date_add(DATE'2023-11-02', CAST(pmod(datediff(CAST({column} AS DATE), DATE'1995-01-01'), 90) AS INT))"


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(parts, items.l_partkey == parts.p_partkey)
        .selectExpr(
            f"CAST({fold('l_shipdate')} AS TIMESTAMP_NTZ) + make_dt_interval(0, l_linenumber, 0, 0) AS usage_time",
            "CAST(l_orderkey AS STRING) AS query_id",
            # the directory lacks service accounts (5-LOW), and some calls carry no user at all
            "CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '5-LOW' THEN -1 - o_custkey "
            "ELSE o_custkey END AS user_id",
            "CASE l_returnflag WHEN 'A' THEN 'COMPLETE' WHEN 'N' THEN 'TRANSLATE' ELSE 'EMBED_TEXT_768' END "
            "AS function_name",
            "CASE p_type WHEN 'STANDARD' THEN 'llama3.1-70b' WHEN 'LARGE' THEN 'llama3.1-405b' "
            "WHEN 'ECONOMY' THEN 'mistral-7b' WHEN 'SMALL' THEN 'claude-3-haiku' WHEN 'MEDIUM' THEN 'in-house-1' END "
            "AS model_name",
            "CASE l_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'n/a' ELSE CAST(l_suppkey AS STRING) END AS warehouse_id",
            "CAST(l_quantity - 1 AS BIGINT) * 100 AS tokens",
            f"CAST(l_extendedprice / 1000 AS {MONEY}) AS token_credits",
            "concat('{\"input\": ', CAST(CAST(l_quantity - 1 AS BIGINT) * 100 AS STRING), '}') AS tokens_granular",
            "concat('{\"tier\": \"', l_linestatus, '\"}') AS token_credits_granular",
        )
    )


def _events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.where(events.event_type.isin(*kinds)).selectExpr(
        "*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k"
    )


def analyst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "click", "view").selectExpr(
        "ts AS start_time",
        "ts + INTERVAL 1 MINUTE AS end_time",
        "CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('user_', CAST(user_id AS STRING)) END AS username",
        f"CAST(value / 100 AS {MONEY}) AS credits",
        "k AS request_count",
    )


def search_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _events(spark, sf_dir, "signup").selectExpr(
        "CAST(ts AS DATE) AS usage_date",
        "user_id % 5 AS service_id",
        "CASE WHEN user_id % 2 = 0 THEN 'EMBED_TEXT_TOKENS' ELSE 'SERVING' END AS consumption_type",
        f"CAST(value / 100 AS {MONEY}) AS credits",
        "k",
    ).groupBy("usage_date", "service_id", "consumption_type")
    return grouped.agg({"credits": "sum", "k": "sum"}).selectExpr(
        "usage_date",
        "'sales' AS database_name",
        "'public' AS schema_name",
        "concat('svc_', CAST(service_id AS STRING)) AS service_name",
        "service_id",
        "consumption_type",
        f"CAST(`sum(credits)` AS {MONEY}) AS credits",
        "'embed-small' AS model_name",
        "CASE WHEN service_id = 4 THEN 'n/a' ELSE CAST(`sum(k)` AS STRING) END AS tokens",
    )


def search_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "error").selectExpr(
        "ts AS start_time",
        "ts + INTERVAL 1 MINUTE AS end_time",
        "'sales' AS database_name",
        "'public' AS schema_name",
        "concat('svc_', CAST(user_id % 5 AS STRING)) AS service_name",
        "user_id % 5 AS service_id",
        f"CAST(value / 100 AS {MONEY}) AS credits",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    start = f"CAST({fold('o_orderdate')} AS TIMESTAMP_NTZ)"
    return docs.join(orders, docs.doc_id == orders.o_orderkey).selectExpr(
        # Spanish documents come from a client whose queries are not in the query history
        "CASE WHEN lang = 'es' THEN concat('ext_', CAST(doc_id AS STRING)) ELSE CAST(doc_id AS STRING) END AS query_id",
        f"{start} AS start_time",
        f"{start} + INTERVAL 5 MINUTES AS end_time",
        "CASE WHEN lang = 'en' THEN 'PARSE_DOCUMENT' ELSE 'AI_EXTRACT' END AS function_name",
        "lang AS model_name",
        "source AS operation_name",
        "n_chars div 1800 AS page_count",
        "CAST(1 AS BIGINT) AS document_count",
        "n_chars % 7 AS feature_count",
        f"CAST(n_chars / 10000D AS {MONEY}) AS credits_used",
    )


def documents_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "CAST(date_add(DATE'2023-11-02', CAST(page_id % 90 AS INT)) AS TIMESTAMP_NTZ)"
    return table(spark, sf_dir, "pages").selectExpr(
        "concat('page_', CAST(page_id AS STRING)) AS query_id",
        f"{start} AS start_time",
        f"{start} + INTERVAL 5 MINUTES AS end_time",
        "split_part(url, '/', 4) AS operation_name",
        "CAST(length(html) AS BIGINT) div 2000 AS page_count",
        "CAST(1 AS BIGINT) AS document_count",
        "CAST(length(html) % 7 AS BIGINT) AS feature_count",
        f"CAST(length(html) / 10000D AS {MONEY}) AS credits_used",
    )


def fine_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "purchase").selectExpr(
        "ts AS start_time",
        "ts + INTERVAL 1 HOUR AS end_time",
        "concat('model_', CAST(user_id % 4 AS STRING)) AS model_name",
        f"CAST(value / 10 AS {MONEY}) AS token_credits",
        "k * 1000 AS tokens",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_name AS name")


def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(
        "CAST(o_orderkey AS STRING) AS query_id",
        "c_name AS user_name",
        f"CAST({fold('o_orderdate')} AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT), 0) "
        "AS start_time",
        "concat('SELECT * FROM V_', o_orderpriority) AS query_text",
        "CASE WHEN o_orderstatus = 'F' THEN '100035' END AS error_code",
        "CASE WHEN o_orderstatus = 'F' THEN concat('timeout in ', o_orderpriority) END AS error_message",
        "CAST(round(o_totalprice) AS BIGINT) AS total_elapsed_time",
        "o_orderkey * 1024 AS bytes_scanned",
        "o_custkey % 100 AS partitions_scanned",
        "CASE WHEN o_orderstatus = 'F' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status",
    )


def metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        f"{fold('o_orderdate')} AS usage_date",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'AI_SERVICES' ELSE 'WAREHOUSE_METERING' END "
        "AS service_type",
        f"CAST(o_totalprice / 1000 AS {MONEY}) AS credits_used",
        f"CAST(o_totalprice * 9 / 10000 AS {MONEY}) AS credits_used_compute",
        f"CAST(o_totalprice / 10000 AS {MONEY}) AS credits_used_cloud_services",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> Telemetry:
    makers = (
        analyst, search_daily, search_serving, functions, documents, documents_legacy, fine_tuning, metering, users,
        query_history,
    )
    return Telemetry(**{make.__name__: partial(make, spark, sf_dir) for make in makers})


def account_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily usage of many accounts in the layout of the usage CSV; an account is a nation's customers.

    Orders shrink to one row per customer, day and service before they meet the customers, so a customer with a huge
    share of the orders costs nothing extra, and the distinct users of a day are a plain count.
    """
    service = (
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Analyst' WHEN '2-HIGH' THEN 'Search' WHEN '3-MEDIUM' THEN 'Functions' "
        "WHEN '4-NOT SPECIFIED' THEN 'Document Processing' ELSE 'Fine-tuning' END"
    )
    per_customer = (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "o_custkey", f"{fold('o_orderdate')} AS date", f"{service} AS service_type",
            f"CAST(o_totalprice / 1000 AS {MONEY}) AS credits", "CAST(floor(o_totalprice / 50) AS BIGINT) AS operations",
        )
        .groupBy("o_custkey", "date", "service_type")
        .agg({"credits": "sum", "operations": "sum"})
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        per_customer.join(customers, per_customer.o_custkey == customers.c_custkey)
        .selectExpr("concat('acct_', CAST(c_nationkey AS STRING)) AS account", "date", "service_type",
                    "`sum(credits)` AS credits", "`sum(operations)` AS operations")
        .groupBy("account", "date", "service_type")
        .agg({"*": "count", "operations": "sum", "credits": "sum"})
        .selectExpr("account", "date", "service_type", "`count(1)` AS daily_unique_users",
                    "`sum(operations)` AS total_operations", "CAST(`sum(credits)` AS DECIMAL(38,6)) AS total_credits")
    )


def uploaded_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows as uploaded by accounts, with negative and missing credits and an unknown service among them."""
    service = (
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'Analyst' WHEN 'AUTOMOBILE' THEN 'Search' WHEN 'FURNITURE' THEN 'Functions' "
        "WHEN 'MACHINERY' THEN 'Document Processing' ELSE 'Legacy Bot' END"
    )
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('acct_', CAST(c_nationkey AS STRING)) AS account",
        "date_add(DATE'2023-11-02', CAST(c_custkey % 90 AS INT)) AS date",
        f"{service} AS service_type",
        "c_custkey % 50 AS daily_unique_users",
        "c_custkey AS total_operations",
        "CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey % 2 = 0 THEN NULL "
        "ELSE CAST(CAST(c_acctbal / 1000 AS DECIMAL(18,6)) + CAST(0.9 AS DECIMAL(18,6)) AS DECIMAL(38,6)) END AS total_credits",
    )


def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that accounts (customers) already hold: a changed value of a known setting and one of their own."""
    rows = (
        "explode(array("
        "struct('CREDIT_COST_USD' AS setting_name, CAST(c_nationkey AS STRING) AS setting_value, 'old text' AS description, "
        "'STRING' AS data_type), "
        "struct('TEAM' AS setting_name, c_mktsegment AS setting_value, 'Owning team' AS description, 'STRING' AS data_type)"
        ")) AS s"
    )
    return (
        table(spark, sf_dir, "customer")
        .selectExpr("c_custkey AS account", rows)
        .selectExpr(
            "account", "s.*", "TIMESTAMP_NTZ'2023-12-01 00:00:00' AS updated_at", "'admin' AS updated_by"
        )
    )


def threshold_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert thresholds that some accounts (nations of customers) have changed, one of them to a text that is no number."""
    value = "CASE WHEN c_nationkey % 6 = 0 THEN 'much' ELSE CAST(CAST(0.05 * (c_nationkey % 7 + 4) AS DECIMAL(4,2)) AS STRING) END"
    return table(spark, sf_dir, "customer").select("c_nationkey").distinct().where("c_nationkey % 2 = 0").selectExpr(
        "concat('acct_', CAST(c_nationkey AS STRING)) AS account",
        f"inline(array(struct('ANOMALY_THRESHOLD_HIGH' AS setting_name, {value} AS setting_value), "
        "struct('ANOMALY_THRESHOLD_MEDIUM' AS setting_name, CASE WHEN c_nationkey % 4 = 0 THEN '0.10' END AS setting_value)))",
    )


#: Account days as a table may hold them: some rows have wrong ratios, missing values, impossible dates or negative credits.
#: The expressions mean the same in both engines.
FAULTY_DAYS = [
    "account",
    "CASE WHEN account = 'acct_2' AND day(usage_date) = 5 THEN usage_date + 400 WHEN account = 'acct_4' AND day(usage_date) = 6 "
    "THEN CAST('2019-06-01' AS DATE) ELSE usage_date END AS usage_date",
    "CASE WHEN account = 'acct_5' AND day(usage_date) % 7 = 0 THEN NULL ELSE service_type END AS service_type",
    "CASE WHEN account = 'acct_3' AND day(usage_date) = 12 THEN NULL ELSE daily_unique_users END AS daily_unique_users",
    "total_operations",
    "CASE WHEN account = 'acct_7' AND day(usage_date) = 11 THEN NULL WHEN account = 'acct_1' AND day(usage_date) < 10 THEN -total_credits "
    "ELSE total_credits END AS total_credits",
    "CASE WHEN account = 'acct_3' THEN credits_per_user * 2 ELSE credits_per_user END AS credits_per_user",
]
