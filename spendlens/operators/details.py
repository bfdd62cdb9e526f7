"""Per-service detail: lookback filter and projection, no shuffle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import per_million0, ratio0, text_to_number
from ..sources.telemetry import Telemetry


def _day(column: str):
    return F.col(column).cast("date").alias("usage_date")


def analyst_detail(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    return t.recent("analyst", as_of, lookback_days).select(
        F.lit(S.ANALYST).alias("service_type"), _day("start_time"),
        "start_time", "end_time", "username", "credits", "request_count",
    )


def search_detail(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    return t.recent("search_daily", as_of, lookback_days).select(
        F.lit(S.SEARCH).alias("service_type"), _day("usage_date"),
        "database_name", "schema_name", "service_name", "service_id", "consumption_type", "credits", "model_name",
        text_to_number("tokens").alias("tokens"),
    )


def search_serving_detail(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    return t.recent("search_serving", as_of, lookback_days).select(
        F.lit(S.SEARCH_SERVING).alias("service_type"), _day("start_time"),
        "start_time", "end_time", "database_name", "schema_name", "service_name", "service_id", "credits",
    )


def functions_detail(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    return t.recent("functions", as_of, lookback_days).select(
        F.lit(S.FUNCTIONS).alias("service_type"), _day("usage_time"),
        F.col("usage_time").alias("start_time"),
        (F.col("usage_time") + F.expr("INTERVAL 1 HOUR")).alias("end_time"),
        "function_name", "model_name", text_to_number("warehouse_id").alias("warehouse_id"), "token_credits", "tokens",
    )


def functions_query_detail(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    return t.recent("functions", as_of, lookback_days).select(
        F.lit(S.FUNCTIONS_QUERY).alias("service_type"), "query_id",
        text_to_number("warehouse_id").alias("warehouse_id"), "model_name", "function_name", "tokens", "token_credits",
        "tokens_granular", "token_credits_granular",
        per_million0("token_credits", "tokens").alias("cost_per_million_tokens"),
    )


def document_legacy_detail(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    return t.recent("documents_legacy", as_of, lookback_days).select(
        F.lit(S.DOCUMENT_LEGACY).alias("service_type"), _day("start_time"),
        "start_time", "end_time", "credits_used", "query_id", "operation_name", "page_count", "document_count",
        "feature_count",
    )


def document_detail(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    return t.recent("documents", as_of, lookback_days).select(
        F.lit(S.DOCUMENTS).alias("service_type"), _day("start_time"),
        "query_id", "credits_used", "start_time", "end_time", "function_name", "model_name", "operation_name",
        "page_count", "document_count", "feature_count",
        ratio0("credits_used", "page_count").alias("credits_per_page"),
        ratio0("credits_used", "document_count").alias("credits_per_document"),
    )


def fine_tuning_detail(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    return t.recent("fine_tuning", as_of, lookback_days).select(
        F.lit(S.FINE_TUNING).alias("service_type"), _day("start_time"),
        "start_time", "end_time", "model_name", "token_credits", "tokens",
        per_million0("token_credits", "tokens").alias("cost_per_million_tokens"),
    )
