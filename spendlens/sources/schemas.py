"""Declared schemas of the usage tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Money keeps twelve decimals; sums have room for more digits before the point.
MONEY = "DECIMAL(26,12)"
TOTAL = "DECIMAL(38,12)"

SCHEMAS = {
    "analyst": f"start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, username STRING, credits {MONEY}, request_count BIGINT",
    "search_daily": (
        "usage_date DATE, database_name STRING, schema_name STRING, service_name STRING, service_id BIGINT, "
        f"consumption_type STRING, credits {MONEY}, model_name STRING, tokens STRING"
    ),
    "search_serving": (
        "start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, database_name STRING, schema_name STRING, "
        f"service_name STRING, service_id BIGINT, credits {MONEY}"
    ),
    "functions": (
        "usage_time TIMESTAMP_NTZ, query_id STRING, user_id BIGINT, function_name STRING, model_name STRING, "
        f"warehouse_id STRING, tokens BIGINT, token_credits {MONEY}, tokens_granular STRING, "
        "token_credits_granular STRING"
    ),
    "documents": (
        "query_id STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, function_name STRING, model_name STRING, "
        f"operation_name STRING, page_count BIGINT, document_count BIGINT, feature_count BIGINT, credits_used {MONEY}"
    ),
    "documents_legacy": (
        "query_id STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, operation_name STRING, "
        f"page_count BIGINT, document_count BIGINT, feature_count BIGINT, credits_used {MONEY}"
    ),
    "fine_tuning": (
        f"start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, model_name STRING, token_credits {MONEY}, tokens BIGINT"
    ),
    "metering": (
        f"usage_date DATE, service_type STRING, credits_used {MONEY}, credits_used_compute {MONEY}, "
        f"credits_used_cloud_services {MONEY}"
    ),
    "users": "user_id BIGINT, name STRING",
    "query_history": (
        "query_id STRING, user_name STRING, start_time TIMESTAMP_NTZ, query_text STRING, error_code STRING, "
        "error_message STRING, total_elapsed_time BIGINT, bytes_scanned BIGINT, partitions_scanned BIGINT, "
        "execution_status STRING"
    ),
}

# Column that the lookback filter of each usage table applies to.
TIME_COLUMN = {
    "analyst": "start_time",
    "search_daily": "usage_date",
    "search_serving": "start_time",
    "functions": "usage_time",
    "documents": "start_time",
    "documents_legacy": "start_time",
    "fine_tuning": "start_time",
    "metering": "usage_date",
    "query_history": "start_time",
}

SNAPSHOT_SCHEMA = (
    "snapshot_date DATE, service_type STRING, usage_date DATE, daily_unique_users BIGINT, total_operations BIGINT, "
    f"total_credits {TOTAL}, credits_per_user DOUBLE, credits_per_operation DOUBLE, function_name STRING, "
    "model_name STRING, total_tokens BIGINT, cost_per_million_tokens DOUBLE, serverless_calls BIGINT, "
    "compute_calls BIGINT, total_pages_processed BIGINT, total_documents_processed BIGINT, credits_per_page DOUBLE, "
    "credits_per_document DOUBLE, inserted_at TIMESTAMP_NTZ"
)

USAGE_CSV_REQUIRED = (
    f"DATE DATE, SERVICE_TYPE STRING, DAILY_UNIQUE_USERS BIGINT, TOTAL_OPERATIONS BIGINT, TOTAL_CREDITS {TOTAL}"
)

FORECAST_SCHEMA = (
    "service_type STRING, forecast_date DATE, forecast_credits DOUBLE, lower_bound_credits DOUBLE, "
    "upper_bound_credits DOUBLE"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def names(ddl: str) -> list[str]:
    """Column names, also before a session exists (columns are separated by a comma and a space)."""
    return [column.split()[0] for column in ddl.split(", ")]
