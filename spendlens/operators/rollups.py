"""Aggregated views: functions and models, query cost, daily summary, metering."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import (
    long_lit, mean, per_million0, per_million_null, ratio0, ratio_null, round_cents, text_to_number,
)
from ..functions.ranking import exact_quantiles, rank_rows
from ..sources.schemas import TOTAL
from ..sources.telemetry import Telemetry
from . import details


def _function_calls(t: Telemetry, as_of: datetime, lookback_days: int) -> DataFrame:
    return t.recent("functions", as_of, lookback_days).withColumn("_warehouse", text_to_number("warehouse_id"))


def _serverless_calls() -> Column:
    return F.count_if(F.col("_warehouse").isNull() | (F.col("_warehouse") == 0)).alias("serverless_calls")


def _compute_calls() -> Column:
    return F.count_if(F.col("_warehouse") > 0).alias("compute_calls")


def function_summary(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    return (
        _function_calls(t, as_of, lookback_days)
        .groupBy("function_name", "model_name")
        .agg(
            F.count_distinct("query_id").alias("call_count"),
            F.sum("token_credits").alias("total_credits"),
            F.sum("tokens").alias("total_tokens"),
            mean("token_credits").alias("avg_credits_per_call"),
            mean("tokens").alias("avg_tokens_per_call"),
            F.min("usage_time").alias("first_usage"),
            F.max("usage_time").alias("last_usage"),
            _serverless_calls(),
            _compute_calls(),
        )
        .withColumns({
            "cost_per_million_tokens": per_million0("total_credits", "total_tokens"),
            "days_in_use": (F.datediff("last_usage", "first_usage") + 1).cast("long"),
        })
    )


def model_comparison(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    """Use, cost and credit quantiles per model. The records are aggregated once, to one row per model and query; distinct
    functions are counted on the few (model, function) pairs."""
    calls = t.recent("functions", as_of, lookback_days).where(F.col("model_name").isNotNull())
    per_query = calls.groupBy("model_name", "query_id").agg(
        F.sum("token_credits").alias("credits"), F.count("token_credits").alias("credit_records"),
        F.sum("tokens").alias("tokens"), F.count("tokens").alias("token_records"),
        F.min("usage_time").alias("first_usage"), F.max("usage_time").alias("last_usage"),
    )

    def per_record(total: str, records: str) -> Column:
        return F.when(F.sum(records) > 0, F.sum(total).cast("double") / F.sum(records))

    functions = calls.select("model_name", "function_name").distinct().groupBy("model_name").agg(
        F.count("function_name").alias("functions_used"))
    totals = per_query.groupBy("model_name").agg(
        F.count("query_id").alias("total_calls"),
        F.sum("credits").alias("total_credits"),
        F.sum("tokens").alias("total_tokens"),
        per_record("credits", "credit_records").alias("avg_credits_per_call"),
        per_record("tokens", "token_records").alias("avg_tokens_per_call"),
        F.min("first_usage").alias("first_usage"),
        F.max("last_usage").alias("last_usage"),
    ).join(functions, "model_name").select(
        "model_name", "functions_used", "total_calls", "total_credits", "total_tokens", "avg_credits_per_call",
        "avg_tokens_per_call", "first_usage", "last_usage",
    )
    # nine decimals drop the binary noise of the interpolation; credits have six
    quantiles = exact_quantiles(
        calls, ["model_name"], "token_credits", {"median_credits": 0.50, "p90_credits": 0.90}
    ).select("model_name", *[F.round(c, 9).alias(c) for c in ("median_credits", "p90_credits")])
    return totals.join(quantiles, "model_name", "left").withColumn(
        "cost_per_million_tokens", per_million0("total_credits", "total_tokens")
    )


def function_daily_trends(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    """``hourly_records`` is the number of distinct queries; the name is kept for existing readers."""
    return (
        _function_calls(t, as_of, lookback_days)
        .groupBy(F.col("usage_time").cast("date").alias("usage_date"), "function_name", "model_name")
        .agg(
            F.count_distinct("query_id").alias("hourly_records"),
            F.sum("token_credits").alias("daily_credits"),
            F.sum("tokens").alias("daily_tokens"),
            _serverless_calls(),
            _compute_calls(),
        )
    )


def _query_costs(t: Telemetry, as_of: datetime, lookback_days: int) -> DataFrame:
    functions = t.recent("functions", as_of, lookback_days).select(
        F.lit("LLM Functions").alias("service_category"), "query_id", F.col("function_name").alias("operation_name"),
        "model_name", F.col("token_credits").alias("credits_used"), F.col("tokens").alias("units_processed"),
    )
    documents = t.recent("documents", as_of, lookback_days).select(
        F.lit("Document Processing").alias("service_category"), "query_id",
        F.col("function_name").alias("operation_name"), "model_name", "credits_used", "page_count", "document_count",
    )
    return functions.unionByName(documents, allowMissingColumns=True).where(F.col("credits_used") > 0)


def _with_query_efficiency(costs: DataFrame) -> DataFrame:
    return costs.withColumns({
        "cost_per_million_units": per_million_null("credits_used", "units_processed"),
        "cost_per_page": ratio_null("credits_used", "page_count"),
    })


def query_cost_analysis(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    """Every usage record with its cost rank inside its category; the rank needs no sort of a whole category."""
    return _with_query_efficiency(
        rank_rows(_query_costs(t, as_of, lookback_days), ["service_category"], "credits_used", "cost_rank")
    )


def top_queries(t: Telemetry, *, as_of: datetime, k: int = 10, lookback_days: int = 90) -> DataFrame:
    """The k most expensive records per category. Each task keeps k rows before anything is shuffled."""
    tie = F.md5(
        F.concat_ws("|", *[
            F.coalesce(F.col(c).cast("string"), F.lit(""))
            for c in ("query_id", "operation_name", "model_name", "units_processed", "page_count", "document_count")
        ]).cast("binary")
    )
    best = Window.partitionBy("service_category").orderBy(F.desc("credits_used"), "_tie")
    ranked = (
        _query_costs(t, as_of, lookback_days)
        .withColumn("_tie", tie)
        .withColumn("cost_rank", F.row_number().over(best).cast("long"))
        .where(F.col("cost_rank") <= k)
        .drop("_tie")
    )
    return _with_query_efficiency(ranked)


def daily_summary(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    """Users, operations and credits per day and service.

    Function usage shrinks to one row per day and user before it meets the directory, and document usage to one row per
    query before it meets the query history, so hot users and hot queries are combined before the shuffle.
    """
    scope = {"as_of": as_of, "lookback_days": lookback_days}
    columns = ["usage_date", "service_type", "daily_unique_users", "total_operations", "total_credits"]
    no_users = long_lit(0).alias("daily_unique_users")

    analyst = (
        details.analyst_detail(t, **scope)
        .groupBy("usage_date", "service_type")
        .agg(
            F.count_distinct("username").alias("daily_unique_users"),
            F.sum("request_count").alias("total_operations"),
            F.sum("credits").alias("total_credits"),
        )
    )
    # the daily search table already holds serving usage: the serving table is not added again
    embedded = F.when(F.col("consumption_type") == "EMBED_TEXT_TOKENS", F.coalesce("tokens", F.lit(0))).otherwise(0)
    search = (
        details.search_detail(t, **scope)
        .groupBy("usage_date", "service_type")
        .agg(F.sum(embedded).try_cast("long").alias("total_operations"), F.sum("credits").alias("total_credits"))
        .select("*", no_users)
    )
    directory = t.users.select("user_id", F.col("name").alias("user_name"))
    functions = (
        t.recent("functions", as_of, lookback_days)
        .groupBy(F.col("usage_time").cast("date").alias("usage_date"), "user_id")
        .agg(F.sum("tokens").alias("tokens"), F.sum("token_credits").alias("credits"))
        .join(directory, "user_id", "left")
        .groupBy("usage_date")
        .agg(
            F.count_distinct("user_name").alias("daily_unique_users"),
            F.sum("tokens").alias("total_operations"),
            F.sum("credits").alias("total_credits"),
        )
        .withColumn("service_type", F.lit(S.FUNCTIONS))
    )
    # a document is not older than its query, so those from the first day on are enough
    document_users = (
        t.recent("documents", as_of, lookback_days + 1).select("query_id").distinct()
        .join(t.recent("query_history", as_of, lookback_days).select("query_id", "user_name", "start_time"), "query_id")
        .groupBy(F.col("start_time").cast("date").alias("usage_date"))
        .agg(F.count_distinct("user_name").alias("users"))
    )
    documents = (
        details.document_detail(t, **scope)
        .groupBy("usage_date", "service_type")
        .agg(F.sum("page_count").alias("total_operations"), F.sum("credits_used").alias("total_credits"))
        .join(document_users, "usage_date", "left")
        .withColumn("daily_unique_users", F.coalesce("users", long_lit(0)))
    )
    fine_tuning = (
        details.fine_tuning_detail(t, **scope)
        .groupBy("usage_date", "service_type")
        .agg(F.sum("tokens").alias("total_operations"), F.sum("token_credits").alias("total_credits"))
        .select("*", no_users)
    )
    every = analyst.select(*columns)
    for part in (search, functions, documents, fine_tuning):
        every = every.unionByName(part.select(*columns))
    return with_ratios(every.withColumn("total_credits", F.col("total_credits").cast(TOTAL)))


def with_ratios(daily: DataFrame) -> DataFrame:
    return daily.withColumns({
        "credits_per_user": ratio0("total_credits", "daily_unique_users"),
        "credits_per_operation": ratio0("total_credits", "total_operations"),
    })


def cost_export(daily: DataFrame) -> DataFrame:
    """Usage-file layout of the daily summary. The weekly and monthly user columns repeat the daily value."""
    return daily.select(
        F.col("usage_date").alias("date"), "service_type", "daily_unique_users",
        F.col("daily_unique_users").alias("weekly_active_users"),
        F.col("daily_unique_users").alias("monthly_active_users"),
        "total_operations", "total_credits", "credits_per_user", "credits_per_operation",
        round_cents("credits_per_user", 4).alias("avg_daily_cost_per_user"),
        round_cents(F.col("credits_per_user") * 30).alias("projected_monthly_cost_per_user"),
        round_cents(F.col("total_credits") * 30).alias("projected_monthly_total_credits"),
    )


def metering_by_service(
    t: Telemetry, *, as_of: datetime, lookback_days: int = 90, service_type: str = "AI_SERVICES"
) -> DataFrame:
    return (
        t.recent("metering", as_of, lookback_days)
        .where(F.col("service_type") == service_type)
        .groupBy("usage_date", "service_type")
        .agg(
            F.sum("credits_used").alias("total_credits"),
            F.sum("credits_used_compute").alias("compute_credits"),
            F.sum("credits_used_cloud_services").alias("cloud_services_credits"),
        )
    )
