"""Spend by user: which users drive which cost with which feature."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import day_before, ratio_null
from ..sources.telemetry import Telemetry

GRAIN = ["usage_date", "user_name", "service_type", "feature_name", "model_name"]


def user_spend_attribution(t: Telemetry, *, as_of: datetime, lookback_days: int = 90) -> DataFrame:
    """Analyst usage names its user, function usage carries a user id (kept when the directory lacks it), document
    usage is reached through its query and dated by that query. Usage is combined per join key before each join."""
    no_model = F.lit(None).cast("string").alias("model_name")
    analyst = (
        t.recent("analyst", as_of, lookback_days)
        .groupBy(F.col("start_time").cast("date").alias("usage_date"), F.col("username").alias("user_name"))
        .agg(F.sum("credits").alias("credits_used"), F.sum("request_count").alias("operations"))
        .select("*", F.lit(S.ANALYST).alias("service_type"), F.lit(S.ANALYST).alias("feature_name"), no_model)
    )

    def combine(df: DataFrame, service: str) -> DataFrame:
        return (
            df.groupBy("usage_date", "user_name", "feature_name", "model_name")
            .agg(F.sum("credits").alias("credits_used"), F.sum("units").alias("operations"))
            .withColumn("service_type", F.lit(service))
        )

    functions = combine(
        t.recent("functions", as_of, lookback_days)
        .groupBy(
            F.col("usage_time").cast("date").alias("usage_date"), "user_id",
            F.col("function_name").alias("feature_name"), "model_name",
        )
        .agg(F.sum("token_credits").alias("credits"), F.sum("tokens").alias("units"))
        .join(t.users.select("user_id", F.col("name").alias("user_name")), "user_id", "left"),
        S.FUNCTIONS,
    )
    queries = t.recent("query_history", as_of, lookback_days).select(
        "query_id", "user_name", F.col("start_time").cast("date").alias("usage_date")
    )
    documents = combine(
        # a document is not older than its query, so those from the first day on are enough
        t.recent("documents", as_of, lookback_days + 1).groupBy("query_id", F.col("function_name").alias("feature_name"), "model_name")
        .agg(F.sum("credits_used").alias("credits"), F.sum("page_count").alias("units"))
        .join(queries, "query_id"),
        S.DOCUMENTS,
    )
    columns = [*GRAIN, "credits_used", "operations"]
    every = analyst.select(*columns).unionByName(functions.select(*columns)).unionByName(documents.select(*columns))
    return every.withColumn("credits_per_operation", ratio_null("credits_used", "operations"))


def user_spend_window(attribution: DataFrame, *, as_of: datetime, lookback_days: int = 30) -> DataFrame:
    return attribution.where(F.col("usage_date") >= F.lit(day_before(as_of, lookback_days)))


def user_spend_summary(attribution: DataFrame) -> DataFrame:
    """One row per user: total, one column per service, activity.

    Rows first shrink to one per user and day, so active days are a plain count; a flag per service replaces the second
    distinct count.
    """
    services = {S.ANALYST: "analyst", S.FUNCTIONS: "functions", S.DOCUMENTS: "document_processing"}

    def only(service: str, value: Column) -> Column:
        return F.when(F.col("service_type") == service, value)

    per_day = attribution.groupBy("user_name", "usage_date").agg(
        F.sum("credits_used").alias("credits_used"),
        *[F.sum(F.coalesce(only(s, F.col("credits_used")), F.lit(0))).alias(n) for s, n in services.items()],
        *[F.max(F.coalesce(only(s, F.lit(1)), F.lit(0))).alias(f"has_{n}") for s, n in services.items()],
    )
    uses = [F.max(f"has_{n}") for n in services.values()]
    return per_day.groupBy("user_name").agg(
        F.sum("credits_used").alias("total_credits_used"),
        *[F.sum(n).alias(f"{n}_credits_used") for n in services.values()],
        F.min("usage_date").alias("first_usage_date"),
        F.max("usage_date").alias("last_usage_date"),
        F.count("usage_date").alias("active_days"),
        (uses[0] + uses[1] + uses[2]).cast("long").alias("services_used"),
    )


def user_feature_usage(attribution: DataFrame) -> DataFrame:
    return attribution.groupBy("user_name", "service_type", "feature_name", "model_name").agg(
        F.sum("credits_used").alias("total_credits_used"),
        F.sum("operations").alias("total_operations"),
        F.min("usage_date").alias("first_usage_date"),
        F.max("usage_date").alias("last_usage_date"),
    )


def user_totals(attribution: DataFrame, *, price: float = S.CREDIT_PRICE_USD) -> DataFrame:
    """Header figures: attributed credits, cost and number of users."""
    return attribution.agg(
        F.sum("credits_used").alias("total_credits"),
        (F.sum("credits_used").cast("double") * price).alias("total_cost_usd"),
        F.count_distinct("user_name").alias("unique_users"),
    )


def top_users(attribution: DataFrame, *, k: int = 15, price: float = S.CREDIT_PRICE_USD) -> DataFrame:
    return (
        attribution.where(F.col("user_name").isNotNull())
        .groupBy("user_name")
        .agg(F.sum("credits_used").alias("credits_used"))
        .withColumn("cost_usd", F.col("credits_used").cast("double") * price)
        .orderBy(F.desc_nulls_first("credits_used"), "user_name")
        .limit(k)
    )


def user_hierarchy(attribution: DataFrame) -> DataFrame:
    """Credits at each level user -> service -> feature -> model; unnamed users are left out, as in the top list."""
    return (
        attribution.where(F.col("user_name").isNotNull())
        .groupBy("user_name", "service_type", "feature_name", F.coalesce("model_name", F.lit("(none)")).alias("model_name"))
        .agg(F.sum("credits_used").alias("credits_used"))
    )


def user_hierarchy_levels(attribution: DataFrame) -> DataFrame:
    """All levels of the hierarchy in one result; NULL marks the levels that are summed up."""
    leaves = user_hierarchy(attribution)
    return leaves.rollup("user_name", "service_type", "feature_name", "model_name").agg(
        F.sum("credits_used").alias("credits_used"), F.grouping_id().cast("long").alias("summed_levels")
    )


def user_drilldown(
    attribution: DataFrame, *, users: Sequence[str] | None = None, price: float = S.CREDIT_PRICE_USD
) -> DataFrame:
    """Service, feature and model breakdown of the named users, or of every user."""
    rows = attribution.where(F.col("user_name").isin(list(users))) if users is not None else attribution
    return (
        rows.where(F.col("user_name").isNotNull())
        .groupBy("user_name", "service_type", "feature_name", F.coalesce("model_name", F.lit("(none)")).alias("model_name"))
        .agg(F.sum("credits_used").alias("credits_used"))
        .withColumn("cost_usd", F.col("credits_used").cast("double") * price)
    )
