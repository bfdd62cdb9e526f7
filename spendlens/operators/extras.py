"""Further reports: reconciliation, periods, single functions, query reports, texts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import day_before, dbl, mean, round_cents, ts
from ..sources.schemas import TOTAL
from ..sources.telemetry import Telemetry


def metering_reconcile(daily: DataFrame, metered: DataFrame, *, as_of: datetime, days: int = 30) -> DataFrame:
    """Credits per day of the rollup next to the metered credits of the same day, from one union and one aggregate."""
    start = F.lit(day_before(as_of, days))
    zero = F.lit(0).cast(TOTAL)
    both = (
        daily.select("usage_date", F.col("total_credits").alias("monitored"), zero.alias("metered"))
        .unionByName(metered.select("usage_date", zero.alias("monitored"), F.col("total_credits").alias("metered")))
        .where(F.col("usage_date") >= start)
    )
    return both.groupBy("usage_date").agg(
        F.sum("monitored").cast("double").alias("monitored_credits"),
        F.sum("metered").cast("double").alias("metered_credits"),
        (F.sum("monitored") - F.sum("metered")).cast("double").alias("difference"),
    )


def metering_totals(reconciled: DataFrame) -> DataFrame:
    """The whole window as (source, credits) rows."""
    totals = reconciled.agg(*[
        F.sum(F.col(c).cast("decimal(28,6)")).cast("double").alias(n)
        for c, n in (("monitored_credits", "Monitoring"), ("metered_credits", "Metering"))
    ])
    return totals.unpivot([], ["Monitoring", "Metering"], "source", "credits")


def weekly_rollup(export: DataFrame) -> DataFrame:
    return export.groupBy(F.trunc("date", "week").alias("week"), "service_type").agg(
        F.sum("total_credits").alias("weekly_credits"), mean("daily_unique_users").alias("avg_users")
    )


def service_activity(daily: DataFrame) -> DataFrame:
    return daily.groupBy("service_type").agg(
        F.min("usage_date").alias("first_date"),
        F.max("usage_date").alias("last_date"),
        F.sum("total_credits").alias("total_credits"),
        F.count_distinct("usage_date").alias("days_active"),
    )


def distinct_services(daily: DataFrame) -> DataFrame:
    return daily.select("service_type").distinct()


def function_cost_monthly(
    t: Telemetry, *, function_name: str, as_of: datetime, months: int = 3, price: float = S.CREDIT_PRICE_USD
) -> DataFrame:
    start = ts(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))
    return (
        t.functions.where((F.col("function_name") == function_name) & (F.col("usage_time") >= start))
        .groupBy(F.trunc(F.col("usage_time").cast("date"), "month").alias("month"), "model_name")
        .agg(F.sum("tokens").alias("total_tokens"), F.sum("token_credits").alias("total_credits"))
        .withColumn("estimated_cost_usd", round_cents(dbl("total_credits") * price))
    )


def function_cost_daily(
    t: Telemetry, *, function_name: str, as_of: datetime, days: int = 30, price: float = S.CREDIT_PRICE_USD
) -> DataFrame:
    return (
        t.recent("functions", as_of, days)
        .where(F.col("function_name") == function_name)
        .groupBy(F.col("usage_time").cast("date").alias("usage_date"))
        .agg(F.count(F.lit(1)).alias("call_count"), F.sum("token_credits").alias("daily_credits"))
        .withColumn("daily_cost_usd", round_cents(dbl("daily_credits") * price))
    )


def cost_share_estimate(
    export: DataFrame, *, service: str = S.FUNCTIONS, share: float = 0.15, price: float = S.CREDIT_PRICE_USD
) -> DataFrame:
    """Estimated part of one service's credits."""
    return export.select(
        "date", "service_type", "total_credits",
        F.when(F.col("service_type") == service, dbl("total_credits") * share).otherwise(F.lit(0.0)).alias("estimated_share_credits"),
        round_cents(dbl("total_credits") * price).alias("total_cost_usd"),
    )


def cost_sentence(export: DataFrame, *, as_of: datetime, days: int = 30, price: float = S.CREDIT_PRICE_USD) -> DataFrame:
    """One sentence per service on its credits and cost of the last 30 days."""
    totals = (
        export.where(F.col("date") >= F.lit(day_before(as_of, days)))
        .groupBy("service_type")
        .agg(F.sum("total_credits").cast(TOTAL).alias("total_credits"))
        .withColumn("total_cost_usd", F.round(F.col("total_credits") * F.lit(price).cast("decimal(10,2)"), 2).cast("decimal(38,2)"))
    )
    return totals.withColumn(
        "summary",
        F.concat(
            F.lit("Service: "), "service_type", F.lit(" consumed "), F.col("total_credits").cast("string"),
            F.lit(" credits costing $"), F.col("total_cost_usd").cast("string"),
        ),
    )


def failed_queries(query_history: DataFrame, *, as_of: datetime, hours: int = 1, user: str | None = None) -> DataFrame:
    """Queries with an error in the last hours, of one user or of all."""
    recent = query_history.where((F.col("start_time") >= ts(as_of - timedelta(hours=hours))) & F.col("error_code").isNotNull())
    if user is not None:
        recent = recent.where(F.col("user_name") == user)
    return recent.select("query_id", "user_name", "start_time", "query_text", "error_code", "error_message")


def slow_queries(query_history: DataFrame, *, pattern: str, as_of: datetime, hours: int = 1) -> DataFrame:
    """Queries whose text matches a pattern (case ignored), with their run time and scan volume."""
    return query_history.where(
        F.col("query_text").ilike(pattern) & (F.col("start_time") >= ts(as_of - timedelta(hours=hours)))
    ).select("query_id", "query_text", "total_elapsed_time", "bytes_scanned", "partitions_scanned")


def text_chunks(documents: DataFrame, *, id_col: str, text_col: str, size: int = 4000) -> DataFrame:
    """Slices of at most ``size`` characters covering the whole text, numbered from 1. Slices are contiguous, so their
    number is known without grouping by document."""
    # the text is cut in one walk; a slice taken by its place would walk from the start again
    slices = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    return documents.where(F.length(text_col) > 0).select(id_col, F.posexplode(slices).alias("_i", "text_chunk")).select(
        id_col, (F.col("_i") + 1).cast("long").alias("chunk_num"), "text_chunk"
    )


def non_ascii_rows(documents: DataFrame, *, text_col: str) -> DataFrame:
    return documents.where(F.col(text_col).rlike("[^\\x00-\\x7F]"))

