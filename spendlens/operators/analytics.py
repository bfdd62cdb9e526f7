"""Calculator analytics over daily usage (date, service_type, daily_unique_users, total_operations, total_credits).

Each function returns one row (or one set of rows) per value of ``group_cols``, so the usage of many accounts is one
table and one job. Usage is reduced to days or services of a group before any window or fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import NONE, OTHER, dbl, filled, listed, mean, mean_over, ratio0, structs, windowed
from .forecast import confidence_interval


def _with_maturity(groups: DataFrame) -> DataFrame:
    """Adds completeness, score and level to rows with days, first_date and last_date."""
    days = F.col("days")
    span = F.datediff("last_date", "first_date") + 1
    score = F.least(days / F.lit(S.MATURITY_CONFIDENT), F.lit(1.0)) * 60 + F.col("completeness") * 40

    def by_days(values: Sequence[str]) -> Column:
        limits = (S.MATURITY_MINIMUM, S.MATURITY_DEVELOPING, S.MATURITY_RELIABLE, S.MATURITY_CONFIDENT)
        c = F.when(days == 0, values[0])
        for limit, value in zip(limits, values[1:]):
            c = c.when(days < limit, value)
        return c.otherwise(values[-1])

    return (
        groups.withColumn("completeness", F.when(days > 1, days / span).otherwise(F.lit(1.0)))
        .withColumn("confidence_score", F.when(days == 0, 0).otherwise(F.floor(score)).cast("long"))
        .withColumn("level", by_days(["none", "insufficient", "developing", "developing", "reliable", "confident"]))
        .withColumn(
            "confidence_label",
            by_days(["No Data", "Insufficient", "Developing", "Improving", "Reliable", "High Confidence"]),
        )
        .withColumn("ready_for_projection", days >= S.MATURITY_MINIMUM)
    )


_DATES = (F.count_distinct, "days"), (F.min, "first_date"), (F.max, "last_date")


def data_maturity(usage: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """How far projections can be trusted: days of data, gaps, a 0-100 score and a level."""
    return _with_maturity(usage.groupBy(*group_cols).agg(*[fn("date").alias(name) for fn, name in _DATES]))


def executive_summary(
    usage: DataFrame, *, price: float = S.CREDIT_PRICE_USD, variance: float | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Run rate, cost per user and the confidence band of the annual cost, with the maturity it rests on."""
    totals = usage.groupBy(*group_cols).agg(
        F.sum("total_credits").cast("double").alias("total_credits"),
        mean("daily_unique_users").alias("avg_users"),
        F.count_distinct("service_type").alias("service_count"),
        *[fn("date").alias(name) for fn, name in _DATES],
    )
    run_rate = (
        _with_maturity(totals)
        .select(
            *group_cols, "total_credits", "avg_users", "service_count", "days", "confidence_score", "confidence_label"
        )
        .withColumn("avg_daily_credits", ratio0("total_credits", "days"))
        .withColumn("monthly_credits", F.col("avg_daily_credits") * 30)
        .withColumn("monthly_cost", F.col("monthly_credits") * price)
        .withColumn("annual_cost", F.col("monthly_credits") * 12 * price)
        .withColumn("cost_per_user_month", ratio0("monthly_cost", "avg_users"))
    )
    return confidence_interval(run_rate, "annual_cost", variance=variance)


def summary_long(summary: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """The summary as (metric, value) rows."""
    metrics = {
        "Analysis Period (days)": dbl("days"),
        "Monthly Cost Estimate": F.col("monthly_cost"),
        "Annual Cost Estimate": F.col("annual_cost"),
        "Lower Bound (Annual)": F.col("lower_bound"),
        "Upper Bound (Annual)": F.col("upper_bound"),
        "Average Daily Users": F.col("avg_users"),
        "Cost per User/Month": F.col("cost_per_user_month"),
        "Data Confidence": dbl("confidence_score"),
    }
    wide = summary.select(*group_cols, *[c.alias(name) for name, c in metrics.items()])
    return wide.unpivot(list(group_cols), [F.col(f"`{m}`") for m in metrics], "metric", "value")


def service_breakdown(
    usage: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Per service: totals, cost, share of the group, and the monthly and annual cost at the group's run rate.

    Services and group totals come from one pass (grouping sets); the totals then reach the services of their group
    through a window over as many rows as the group has services.
    """
    keys = [F.col(c) for c in group_cols]
    sums = usage.groupingSets([[*keys, F.col("service_type")], keys], *keys, "service_type").agg(
        F.sum("total_credits").alias("total_credits"),
        mean("daily_unique_users").alias("avg_daily_users"),
        F.sum("total_operations").alias("total_operations"),
        F.count_distinct("date").alias("_days"),
        F.grouping("service_type").alias("_is_total"),
    )
    group = Window.partitionBy(*(group_cols or [F.lit(1)]))
    is_total = F.col("_is_total") == 1
    credits = dbl("total_credits")
    return (
        sums.withColumn("_total", F.max(F.when(is_total, F.col("total_credits"))).over(group))
        .withColumn("_group_days", F.max(F.when(is_total, F.col("_days"))).over(group))
        .where(~is_total)
        .withColumn("total_cost_usd", credits * price)
        .withColumn("pct_of_total", F.when(F.col("_total") > 0, credits / dbl("_total") * 100).otherwise(F.lit(0.0)))
        .withColumn(
            "monthly_cost_usd",
            F.when(F.col("_group_days") > 0, credits / F.col("_group_days") * 30 * price).otherwise(F.lit(0.0)),
        )
        .withColumn("annual_cost_usd", F.col("monthly_cost_usd") * 12)
        .drop("_total", "_group_days", "_days", "_is_total")
    )


def top_cost_drivers(breakdown: DataFrame, *, k: int = 3, group_cols: Sequence[str] = ()) -> DataFrame:
    """The k services with the highest cost in each group."""
    order = windowed(group_cols, F.desc_nulls_first("total_credits"), F.col("service_type"))
    return (
        breakdown.withColumn("driver_rank", F.row_number().over(order).cast("long"))
        .where(F.col("driver_rank") <= k)
        .select(*group_cols, "driver_rank", "service_type", "total_credits", "monthly_cost_usd", "pct_of_total")
    )


def rolling_30d(usage: DataFrame, *, rows: int = 30, group_cols: Sequence[str] = (), calendar: bool = False) -> DataFrame:
    """Rolling sums of credits and operations and mean users per service, over the last 30 rows or 30 calendar days."""
    series = [*group_cols, "service_type"]
    if calendar:
        w = windowed(series, F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-(rows - 1), 0)
    else:
        w = windowed(series, F.col("date")).rowsBetween(-(rows - 1), 0)
    return (
        usage.withColumn("credits_30d_total", F.sum("total_credits").over(w).cast("double"))
        .withColumn("operations_30d_total", F.sum("total_operations").over(w))
        .withColumn("users_30d_avg", mean_over("daily_unique_users", w))
        .withColumn("cost_per_user_30d", ratio0("credits_30d_total", "users_30d_avg"))
    )


def latest_rolling_30d(
    rolling: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()
) -> DataFrame:
    """The newest rolling row of each service with its costs."""
    values = ["date", "credits_30d_total", "operations_30d_total", "users_30d_avg", "cost_per_user_30d"]
    return (
        rolling.groupBy(*group_cols, "service_type")
        .agg(F.max_by(F.struct(*values), "date").alias("_row"))
        .select(*group_cols, "service_type", "_row.*")
        .withColumn("cost_30d_usd", F.col("credits_30d_total") * price)
        .withColumn("cost_per_user_30d_usd", F.col("cost_per_user_30d") * price)
    )


def latest_rolling_totals(
    latest: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Totals over the services of ``latest_rolling_30d``."""
    exact = F.col("credits_30d_total").cast("decimal(28,6)")
    return (
        latest.groupBy(*group_cols)
        .agg(
            F.sum(exact).cast("double").alias("total_30d_credits"),
            mean(F.col("users_30d_avg").cast("decimal(28,9)")).alias("avg_30d_users"),
        )
        .withColumn("total_30d_cost_usd", F.col("total_30d_credits") * price)
        .withColumn("avg_cost_per_user_30d", ratio0("total_30d_cost_usd", "avg_30d_users"))
    )


def daily_trend(usage: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    return usage.groupBy(*group_cols, "date", "service_type").agg(F.sum("total_credits").alias("total_credits"))


def history_header(
    usage: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Total credits and cost, mean of the daily totals, mean users. One pass: the mean of daily totals is the total
    over the number of days."""
    return (
        usage.groupBy(*group_cols)
        .agg(
            F.sum("total_credits").cast("double").alias("total_credits"),
            F.count_distinct("date").alias("_days"),
            mean("daily_unique_users").alias("avg_daily_users"),
        )
        .withColumn("total_cost_usd", F.col("total_credits") * price)
        .withColumn("avg_daily_credits", ratio0("total_credits", "_days"))
        .drop("_days")
    )


def credit_summary(
    usage: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Per service: credits per day over its date span, extrapolated to a month."""
    return (
        usage.groupBy(*group_cols, "service_type")
        .agg(
            F.sum("total_credits").cast("double").alias("total_credits"),
            mean("daily_unique_users").alias("avg_daily_users"),
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
        )
        .withColumn("days_of_data", (F.datediff("end_date", "start_date") + 1).cast("long"))
        .withColumn("avg_credits_per_day", F.col("total_credits") / F.col("days_of_data"))
        .withColumn("est_credits_per_month", F.col("avg_credits_per_day") * 30)
        .withColumn("est_cost_per_month", F.col("est_credits_per_month") * price)
    )


def function_overview(function_summary: DataFrame, *, price: float = S.CREDIT_PRICE_USD) -> DataFrame:
    return function_summary.agg(
        F.count_distinct("function_name").alias("functions_used"),
        F.count_distinct("model_name").alias("models_used"),
        F.sum("call_count").alias("total_calls"),
        F.sum("total_credits").cast("double").alias("total_credits"),
        (F.sum("total_credits").cast("double") * price).alias("total_cost_usd"),
    )


def top_functions(function_summary: DataFrame, *, k: int = 10, price: float = S.CREDIT_PRICE_USD) -> DataFrame:
    sums = ["call_count", "total_credits", "total_tokens", "serverless_calls", "compute_calls"]
    return (
        function_summary.groupBy("function_name")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .withColumn("cost_usd", dbl("total_credits") * price)
        .orderBy(F.desc_nulls_first("total_credits"), "function_name")
        .limit(k)
    )


def _usd(df: DataFrame, price: float) -> DataFrame:
    return df.withColumn("cost_usd", dbl("total_credits") * price).withColumn(
        "cost_per_million_usd", F.col("cost_per_million_tokens") * price
    )


def function_model_detail(function_summary: DataFrame, *, price: float = S.CREDIT_PRICE_USD) -> DataFrame:
    return _usd(function_summary, price).select(
        "function_name", "model_name", "call_count", "total_credits", "cost_usd", "total_tokens",
        "cost_per_million_usd", "avg_tokens_per_call", "serverless_calls", "compute_calls",
    )


def top_function_models(function_summary: DataFrame, *, k: int = 50) -> DataFrame:
    return (
        function_summary.select(
            "function_name", "model_name", "call_count", "total_credits", "total_tokens", "avg_credits_per_call",
            "avg_tokens_per_call", "cost_per_million_tokens", "serverless_calls", "compute_calls",
        )
        .orderBy(F.desc_nulls_first("total_credits"), "function_name", F.asc_nulls_first("model_name"))
        .limit(k)
    )


def top_models(model_comparison: DataFrame, *, k: int = 20, price: float = S.CREDIT_PRICE_USD) -> DataFrame:
    return (
        _usd(model_comparison, price)
        .select(
            "model_name", "functions_used", "total_calls", "total_credits", "total_tokens", "avg_credits_per_call",
            "cost_per_million_tokens", "median_credits", "p90_credits", "cost_usd", "cost_per_million_usd",
        )
        .orderBy(F.desc_nulls_first("total_credits"), "model_name")
        .limit(k)
    )


def recent_trends(trends: DataFrame, *, since, k: int | None = None) -> DataFrame:
    """The function/model days since a date, newest first and most expensive first within a day; the first k if wanted."""
    newest = trends.where(F.col("usage_date") >= F.lit(since)).orderBy(
        F.desc("usage_date"), F.desc_nulls_first("daily_credits"), "function_name", F.asc_nulls_first("model_name")
    )
    return (newest if k is None else newest.limit(k)).drop("hourly_records")


def function_model_matrix(function_summary: DataFrame, *, models: Sequence[str]) -> DataFrame:
    """Function x model matrix of credits, 0 where a pair is unused. The models become columns, so they are given; credits
    of other models are in ``(other)`` and those without a model in ``(none)``, so a row sums up to the function."""
    columns = [*models, OTHER, NONE]
    return (
        function_summary.withColumn("_model", listed("model_name", models))
        .groupBy("function_name")
        .pivot("_model", columns)
        .agg(F.sum("total_credits").cast("double"))
        .select("function_name", *filled(columns))
    )


def function_daily(trends: DataFrame) -> DataFrame:
    return trends.groupBy("usage_date", "function_name").agg(
        F.sum("daily_credits").alias("daily_credits"), F.sum("daily_tokens").alias("daily_tokens")
    )


def rate_check(usage: DataFrame, *, tolerance: float = 0.5, group_cols: Sequence[str] = ()) -> DataFrame:
    """Observed credits per operation of each service against the published rate, where there is one."""
    service = F.col("service_type")
    is_analyst, is_document = service.contains("Analyst"), service.contains("Document")
    return (
        usage.groupBy(*group_cols, "service_type")
        .agg(F.sum("total_credits").alias("total_credits"), F.sum("total_operations").alias("total_operations"))
        .where(F.col("total_operations") > 0)
        .withColumn("rate_per_operation", ratio0("total_credits", "total_operations"))
        .withColumn(
            "expected_rate",
            F.when(is_analyst, F.lit(S.ANALYST_CREDITS_PER_MESSAGE)).when(is_document, F.lit(S.DOCUMENT_CREDITS_PER_1000_PAGES)),
        )
        .withColumn(
            "observed_rate",
            F.when(is_document & ~is_analyst, F.col("rate_per_operation") * 1000).otherwise(F.col("rate_per_operation")),
        )
        .withColumn("metric", F.when(is_analyst, "messages").when(is_document, "pages").otherwise("operations"))
        .withColumn(
            "status",
            F.when(F.col("expected_rate").isNull(), "No baseline")
            .when(F.abs(F.col("observed_rate") - F.col("expected_rate")) / F.col("expected_rate") < tolerance, "Within range")
            .otherwise("Verify"),
        )
    )


def rate_card(spark) -> tuple[DataFrame, DataFrame]:
    """Published credits per million tokens by model and by function."""

    def fixed(columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
        table = structs(columns, rows, ["string"] + ["double"] * (len(columns) - 1))
        return spark.range(1).select(F.inline(table))

    return (
        fixed(["model_name", "input_rate", "output_rate"], S.MODEL_RATES),
        fixed(["function_name", "function_rate"], S.FUNCTION_RATES),
        spark.range(1).select(F.inline(structs(
            ["function_name", "model_name", "pair_input", "pair_output"], S.FUNCTION_MODEL_RATES, ["string", "string", "double", "double"]))),
    )


def rate_card_join(function_summary: DataFrame, models: DataFrame, functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Actual credits of each function/model against its published rate. A rate of the function with that model wins over
    one of the function, and that over the model's; two rates give a range from all-input to all-output tokens."""
    millions = dbl("total_tokens") / 1_000_000
    low = F.coalesce("pair_input", "function_rate", "input_rate")
    high = F.coalesce("pair_output", "function_rate", "output_rate")
    return (
        function_summary.join(models, "model_name", "left")
        .join(functions, "function_name", "left")
        .join(pairs, ["function_name", "model_name"], "left")
        .select(
            "function_name", "model_name", "total_tokens", "total_credits", "cost_per_million_tokens",
            low.alias("rate_low"), high.alias("rate_high"),
            (millions * low).alias("expected_credits_low"), (millions * high).alias("expected_credits_high"),
            F.when(low.isNull(), "No published rate")
            .when(dbl("total_credits") < millions * low, "Below published rate")
            .when(dbl("total_credits") > millions * high, "Above published rate")
            .otherwise("Within published rate").alias("rate_status"),
        )
    )


def request_baseline(
    usage: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Per service: requests per day with data and cost per request."""
    return (
        usage.groupBy(*group_cols, "service_type")
        .agg(
            F.sum("total_operations").alias("total_operations"),
            mean("daily_unique_users").alias("users_in_env"),
            F.sum("total_credits").alias("total_credits"),
            F.count("date").alias("days_with_data"),
        )
        .withColumn("requests_per_day", ratio0("total_operations", "days_with_data"))
        .withColumn(
            "cost_per_request",
            F.when(F.col("total_operations") > 0, dbl("total_credits") * price / dbl("total_operations")).otherwise(F.lit(0.0)),
        )
    )


def baseline_checks(baseline: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()) -> DataFrame:
    """Plausibility flags on the request baseline."""
    rate = F.col("cost_per_request") / price
    deviation = F.when(
        F.col("service_type") == S.ANALYST,
        F.abs((rate - S.ANALYST_CREDITS_PER_MESSAGE) / S.ANALYST_CREDITS_PER_MESSAGE * 100),
    )
    return baseline.withColumn("rate_deviation_pct", deviation).select(
        *group_cols, "service_type", "rate_deviation_pct",
        F.when(F.col("rate_deviation_pct") < 5, "matches")
        .when(F.col("rate_deviation_pct") < 20, "acceptable")
        .when(F.col("rate_deviation_pct").isNotNull(), "deviates")
        .otherwise("no published rate").alias("rate_status"),
        (F.col("total_operations") == 0).alias("has_no_operations"),
        (F.col("cost_per_request") > 10).alias("has_high_request_cost"),
        (F.col("days_with_data") / 30 * 100).alias("coverage_pct"),
        (F.col("days_with_data") / 30 * 100 < 30).alias("has_low_coverage"),
    )


def persona_costs(
    baseline: DataFrame, *, personas: Sequence[tuple[str, int, int]] = tuple(S.PERSONAS),
    price: float = S.CREDIT_PRICE_USD, published_rate: bool = False, group_cols: Sequence[str] = (),
) -> DataFrame:
    """Monthly cost of user types at the group's mean cost per request, weighted by requests, or at the published rate."""
    exact = "decimal(38,9)"
    requests = F.sum(F.col("requests_per_day").cast(exact)).cast("double") * 30
    cost = F.sum((F.col("requests_per_day") * 30 * F.col("cost_per_request")).cast(exact)).cast("double")
    table = structs(["persona", "users", "requests_per_day"], personas, ["string", "bigint", "bigint"])
    rates = baseline.groupBy(*group_cols).agg(requests.alias("_requests"), cost.alias("_cost"))
    rate = F.lit(S.ANALYST_CREDITS_PER_MESSAGE * price) if published_rate else ratio0("_cost", "_requests")
    return (
        rates.withColumn("cost_per_request", rate)
        .withColumn("_p", F.explode(table))
        .select(*group_cols, "_p.*", (F.col("_p.requests_per_day") * 30).alias("requests_per_month"), "cost_per_request")
        .withColumn("cost_per_user_month", F.col("requests_per_month") * F.col("cost_per_request"))
        .withColumn("total_monthly_cost", F.col("cost_per_user_month") * F.col("users"))
    )


def persona_totals(costs: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    return (
        costs.groupBy(*group_cols)
        .agg(
            F.sum("users").alias("total_users"),
            F.sum(F.col("requests_per_month") * F.col("users")).alias("total_monthly_requests"),
            F.sum(F.col("total_monthly_cost").cast("decimal(38,9)")).cast("double").alias("total_monthly_cost"),
        )
        .withColumn("avg_cost_per_user", ratio0("total_monthly_cost", "total_users"))
    )


def cost_per_user_calculator(
    usage: DataFrame, *, operations_per_user_day: float = 20.0, intensity: float = 1.0, active_days: int = 22,
    price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = (),
) -> DataFrame:
    """Expected credits and cost of one user per service and month, at the observed credits per operation, with the
    service's share of the user's cost."""
    per_service = (
        usage.groupBy(*group_cols, "service_type")
        .agg(F.sum("total_credits").alias("_credits"), F.sum("total_operations").alias("_operations"))
        .withColumn("credits_per_operation", ratio0("_credits", "_operations"))
        .withColumn(
            "credits_per_user_month",
            F.col("credits_per_operation") * F.lit(operations_per_user_day * intensity * active_days),
        )
        .drop("_credits", "_operations")
    )
    exact = F.col("credits_per_user_month").cast("decimal(28,9)")
    total = F.sum(exact).over(Window.partitionBy(*(group_cols or [F.lit(1)]))).cast("double")
    return per_service.withColumn("cost_per_user_month", F.col("credits_per_user_month") * price).withColumn(
        "pct_of_user_cost", F.when(total > 0, F.col("credits_per_user_month") / total * 100).otherwise(F.lit(0.0))
    )


def benchmark_band(usage: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """Credits per user and month of each service against typical values."""
    table = structs(["service", "low", "typical", "high"], S.USAGE_BENCHMARKS, ["string", "double", "double", "double"])
    actual = F.col("credits_per_user_month")
    return (
        usage.groupBy(*group_cols, "service_type")
        .agg(
            F.sum("total_credits").cast("double").alias("_credits"),
            F.count_distinct("date").alias("_days"),
            mean("daily_unique_users").alias("avg_users"),
        )
        .withColumn("credits_per_user_month", ratio0(F.col("_credits") / F.col("_days") * 30, "avg_users"))
        .withColumn("_b", F.try_element_at(F.filter(table, lambda b: b["service"] == F.col("service_type")), F.lit(1)))
        .select(
            *group_cols, "service_type", "avg_users", "credits_per_user_month",
            F.col("_b.low").alias("low"), F.col("_b.typical").alias("typical"), F.col("_b.high").alias("high"),
            F.when(F.col("_b").isNull(), "no benchmark")
            .when(actual < F.col("_b.low"), "below low")
            .when(actual < F.col("_b.typical"), "low to typical")
            .when(actual <= F.col("_b.high"), "typical to high")
            .otherwise("above high").alias("band"),
        )
    )


def summary_report(
    usage: DataFrame, *, growth_rate: float = 0.25, variance: float = 0.10, price: float = S.CREDIT_PRICE_USD,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Current state and 12-month projection in one row per group."""
    current = executive_summary(usage, price=price, group_cols=group_cols).select(
        *group_cols, "days", "service_count", "total_credits", "avg_users",
        (F.col("total_credits") * price).alias("total_cost_usd"),
        (F.col("avg_daily_credits") * price).alias("avg_daily_cost_usd"),
    )
    # every service grows by the same factor, so the year's cost is the window's cost times a constant
    year = sum((1 + growth_rate) ** m for m in range(1, 13))
    return (
        current.withColumn("projected_annual_cost_usd", F.col("total_cost_usd") * F.lit(year))
        .withColumn("lower_bound_usd", F.col("projected_annual_cost_usd") * (1 - variance))
        .withColumn("upper_bound_usd", F.col("projected_annual_cost_usd") * (1 + variance))
        .withColumn("avg_monthly_cost_usd", F.col("projected_annual_cost_usd") / 12)
    )


def run_rate(usage: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()) -> DataFrame:
    """Monthly cost, mean users and confidence score: the input of the scaling and budget scenarios."""
    return executive_summary(usage, price=price, group_cols=group_cols).select(
        *group_cols, "monthly_cost", "avg_users", "confidence_score"
    )
