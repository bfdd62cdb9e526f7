"""Forecasts, growth projections, scaling scenarios and budgets.

Series are aggregated to days before anything is fitted; horizons, scenarios and months are exploded from small array
literals. Fits are closed forms over exact sums, so a recomputed task gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import NONE, OTHER, day_before, dbl, filled, listed, mean, ratio0, structs, windowed
from ..sources.schemas import FORECAST_SCHEMA, TOTAL, struct

# computed values are summed in these types, so sums do not depend on the order of the rows
RESIDUAL = "decimal(28,9)"
SHARE = "decimal(28,18)"
STORED = "decimal(28,12)"


def _growth_months(n: int, *rates: float) -> Column:
    """One row per month 1..n with the compound factor of each rate (g0, g1, ...), from a small array literal."""
    rows = [(m, *[(1.0 + r) ** m for r in rates]) for m in range(1, n + 1)]
    return F.inline(structs(["month", *[f"g{i}" for i in range(len(rates))]], rows, ["int"] + ["double"] * len(rates)))


def forecast_input(snapshots: DataFrame, *, as_of: datetime, days: int = 365, group_cols: Sequence[str] = ()) -> DataFrame:
    """Daily credits per series as (service_type, ts, y)."""
    return (
        snapshots.where(F.col("usage_date") >= F.lit(day_before(as_of, days)))
        .groupBy(*group_cols, "service_type", F.col("usage_date").cast("timestamp_ntz").alias("ts"))
        .agg(F.sum("total_credits").cast(TOTAL).alias("y"))
    )


def forecast_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], struct(FORECAST_SCHEMA))


def _line(x: str, y: str, window: WindowSpec | None = None) -> dict[str, Column]:
    """n, slope and intercept of y over the integer x, as aggregates or over a window; slope 0 where all x are equal."""

    def total(c: Column) -> Column:
        out = F.sum(c)
        return (out.over(window) if window is not None else out).cast("double")

    one = F.lit(1).cast("long")
    yx = F.col(y).cast("decimal(28,12)")
    n, sx, sy = total(one), total(F.col(x)), total(yx)
    spread = n * total(F.col(x) * F.col(x)) - sx * sx
    slope = F.when(spread != 0, (n * total(yx * F.col(x).cast("decimal(8,0)")) - sx * sy) / spread).otherwise(F.lit(0.0))
    return {"n": n, "slope": slope, "intercept": (sy - slope * sx) / n}


def forecast_12m(series_days: DataFrame, *, horizon_days: int = 365, min_points: int = 14, group_cols: Sequence[str] = ()) -> DataFrame:
    """Trend plus weekday effect per series with a 95 % band; series with too few days are dropped.

    The trend is a least-squares line over calendar days, the weekday effect the mean residual of that weekday, the
    band 1.96 standard deviations of what is left. Forecast and lower bound do not fall below zero. The days of a series
    are shuffled once: line, residuals and effects are windows over the same partitioning.
    """
    series = [*group_cols, "service_type"]
    whole = Window.partitionBy(*series)
    same_weekday = Window.partitionBy(*series, "weekday")
    line = _line("x", "y", whole)
    points = (
        series_days.select(*series, F.col("ts").cast("date").alias("day"), F.col("y").cast("decimal(28,12)").alias("y"))
        .withColumn("x", F.datediff("day", F.min("day").over(whole)).cast("long"))
        .withColumn("weekday", F.dayofweek("day"))
        .withColumn("n", line["n"])
        .withColumn("slope", line["slope"])
        .withColumn("intercept", line["intercept"])
        .where(F.col("n") >= min_points)
        .withColumn("residual", dbl("y") - (F.col("intercept") + F.col("slope") * F.col("x")))
        .withColumn(
            "effect",
            F.sum(F.col("residual").cast(RESIDUAL)).over(same_weekday).cast("double")
            / F.count(F.lit(1)).over(same_weekday),
        )
        .withColumn("e", F.col("residual") - F.col("effect"))
        # squares of residuals in units of the largest one fit any magnitude
        .withColumn("scale", F.max(F.abs("e")).over(whole))
        .withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0)))
    )
    model = points.groupBy(*series).agg(
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.max("day").alias("last_day"),
        F.max("x").alias("last_x"),
        F.map_from_entries(F.collect_set(F.struct("weekday", "effect"))).alias("effects"),
        F.max("scale").alias("scale"),
        F.sum((F.col("e") / F.col("scale") * (F.col("e") / F.col("scale"))).cast(SHARE)).cast("double").alias("squares"),
        F.max("n").alias("n"),
    ).withColumn("sigma", F.sqrt(F.col("squares") / (F.col("n") - 1)) * F.col("scale"))
    ahead = model.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon_days)))).withColumn(
        "forecast_date", F.date_add("last_day", F.col("h"))
    )
    value = (
        F.col("intercept") + F.col("slope") * (F.col("last_x") + F.col("h"))
        + F.coalesce(F.try_element_at("effects", F.dayofweek("forecast_date")), F.lit(0.0))
    )
    return ahead.withColumn("_value", value).select(
        *series, "forecast_date",
        F.greatest(F.lit(0.0), F.col("_value")).alias("forecast_credits"),
        F.greatest(F.lit(0.0), F.col("_value") - 1.96 * F.col("sigma")).alias("lower_bound_credits"),
        F.greatest(F.lit(0.0), F.col("_value") + 1.96 * F.col("sigma")).alias("upper_bound_credits"),
    )


def linear_forecast(usage: DataFrame, *, months: int = 12, min_points: int = 7, group_cols: Sequence[str] = ()) -> DataFrame:
    """Straight line through the daily totals of a group (x is the row number of the day), continued int(months * 30.5)
    days, never negative. Groups with fewer than ``min_points`` days are dropped."""
    daily = usage.groupBy(*group_cols, F.col("date").alias("_day")).agg(
        F.sum("total_credits").cast("decimal(28,12)").alias("y")
    )
    points = daily.withColumn("x", (F.row_number().over(windowed(group_cols, F.col("_day"))) - 1).cast("long"))
    fit = (
        points.groupBy(*group_cols)
        .agg(*[c.alias(name) for name, c in _line("x", "y").items()], F.max("_day").alias("last_day"))
        .where(F.col("n") >= min_points)
    )
    return fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(int(months * 30.5))))).select(
        *group_cols,
        F.date_add("last_day", F.col("h")).alias("date"),
        F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("h"))).alias("forecast_credits"),
    )


def linear_forecast_monthly(
    forecast: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()
) -> DataFrame:
    return (
        forecast.groupBy(*group_cols, F.trunc("date", "month").alias("month"))
        .agg(F.sum(F.col("forecast_credits").cast(STORED)).cast("double").alias("forecast_credits"))
        .withColumn("forecast_cost_usd", F.col("forecast_credits") * price)
    )


_BOUNDS = ["forecast_credits", "lower_bound_credits", "upper_bound_credits"]


def forecast_by_month(forecast: DataFrame, *, horizon_days: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Credits and bounds per month and service within the horizon, counted from the group's first forecast day. The
    window spans the forecast days of a group's services, not usage."""
    first = F.min("forecast_date").over(Window.partitionBy(*(group_cols or [F.lit(1)])))
    return (
        forecast.withColumn("_start", first)
        .where(F.col("forecast_date") < F.date_add("_start", horizon_days))
        .groupBy(*group_cols, F.trunc("forecast_date", "month").alias("month"), "service_type")
        .agg(*[F.sum(F.col(c).cast(STORED)).alias(c) for c in _BOUNDS])
    )


def forecast_monthly(by_month: DataFrame, *, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = ()) -> DataFrame:
    totals = by_month.groupBy(*group_cols, "month").agg(*[F.sum(c).cast("double").alias(c) for c in _BOUNDS])
    return totals.select(
        "*",
        (F.col("forecast_credits") * price).alias("forecast_cost_usd"),
        (F.col("lower_bound_credits") * price).alias("lower_cost_usd"),
        (F.col("upper_bound_credits") * price).alias("upper_cost_usd"),
    )


def forecast_pivot(by_month: DataFrame, *, services: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Month x service matrix of forecast credits; the service list is given, so no extra job looks for it. Other services
    are in ``(other)`` and rows without one in ``(none)``, so a row sums up to the month."""
    columns = [*services, OTHER, NONE]
    return (
        by_month.withColumn("_service", listed("service_type", services))
        .groupBy(*group_cols, "month")
        .pivot("_service", columns)
        .agg(F.sum("forecast_credits").cast("double"))
        .select(*group_cols, "month", *filled(columns))
    )


def usage_baseline(usage: DataFrame, *, group_cols: Sequence[str] = (), baseline: str = "window") -> DataFrame:
    """Credits and mean users per service: over the whole window, or scaled to 30 days ('monthly')."""
    base = usage.groupBy(*group_cols, "service_type").agg(
        F.sum("total_credits").cast("double").alias("base_credits"),
        mean("daily_unique_users").alias("base_users"),
        F.count_distinct("date").alias("_days"),
    )
    if baseline == "monthly":
        base = base.withColumn("base_credits", F.col("base_credits") / F.col("_days") * 30)
    elif baseline != "window":
        raise ValueError("baseline must be 'window' or 'monthly'")
    return base.drop("_days")


def growth_projection(
    usage: DataFrame, *, growth_rate: float, months: int = 12, price: float = S.CREDIT_PRICE_USD,
    group_cols: Sequence[str] = (), baseline: str = "window",
) -> DataFrame:
    """Compound monthly growth of credits and users per service."""
    return (
        usage_baseline(usage, group_cols=group_cols, baseline=baseline)
        .select("*", _growth_months(months, growth_rate))
        .select(
            *group_cols, "month", "service_type",
            (F.col("base_credits") * F.col("g0")).alias("projected_credits"),
            (F.col("base_users") * F.col("g0")).alias("projected_users"),
        )
        .withColumn("projected_cost_usd", F.col("projected_credits") * price)
        .withColumn("cost_per_user_usd", ratio0("projected_cost_usd", "projected_users"))
        .withColumn("growth_rate", F.lit(float(growth_rate)))
    )


def growth_monthly_band(projection: DataFrame, *, variance: float = 0.10, group_cols: Sequence[str] = ()) -> DataFrame:
    """Cost per month over all services with a +/- band and the running total."""
    totals = projection.groupBy(*group_cols, "month").agg(
        F.sum(F.col("projected_cost_usd").cast(STORED)).alias("projected_cost_usd")
    )
    running = windowed(group_cols, F.col("month")).rowsBetween(Window.unboundedPreceding, 0)
    cost = dbl("projected_cost_usd")
    return totals.select(
        *group_cols, "month", cost.alias("projected_cost_usd"),
        (cost * (1 - variance)).alias("lower_bound"),
        (cost * (1 + variance)).alias("upper_bound"),
        F.sum("projected_cost_usd").over(running).cast("double").alias("cumulative_cost_usd"),
    )


def growth_cards(monthly_band: DataFrame, *, variance: float = 0.10, group_cols: Sequence[str] = ()) -> DataFrame:
    """Month 1, month 12 (0 when not projected), total and its variance."""
    cost = F.col("projected_cost_usd")
    return (
        monthly_band.groupBy(*group_cols)
        .agg(
            F.max(F.when(F.col("month") == 1, cost)).alias("month_1_cost"),
            F.coalesce(F.max(F.when(F.col("month") == 12, cost)), F.lit(0.0)).alias("month_12_cost"),
            F.max("cumulative_cost_usd").alias("total_cost"),
        )
        .withColumn("variance_usd", F.col("total_cost") * variance)
    )


def growth_scenarios(
    usage: DataFrame, *, months: int = 12, price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = (),
    scenarios: Sequence[tuple[str, float]] = tuple(S.GROWTH_SCENARIOS),
) -> DataFrame:
    """Cost per month under several growth rates."""
    rows = [(name, rate, m, (1.0 + rate) ** m) for name, rate in scenarios for m in range(1, months + 1)]
    table = structs(["scenario", "growth_rate", "month", "factor"], rows, ["string", "double", "int", "double"])
    return (
        usage.groupBy(*group_cols)
        .agg(F.sum("total_credits").cast("double").alias("_credits"))
        .select("*", F.inline(table))
        .select(
            *group_cols, "scenario", "growth_rate", "month",
            (F.col("_credits") * F.col("factor") * price).alias("projected_cost_usd"),
        )
    )


def growth_two_driver(
    usage: DataFrame, *, user_growth: float, intensity_growth: float, months: int = 12,
    price: float = S.CREDIT_PRICE_USD, group_cols: Sequence[str] = (),
) -> DataFrame:
    """Users grow with adoption, credits with adoption times usage per user."""
    return (
        usage_baseline(usage, group_cols=group_cols)
        .select("*", _growth_months(months, user_growth, intensity_growth))
        .select(
            *group_cols, "month", "service_type",
            (F.col("base_users") * F.col("g0")).alias("projected_users"),
            (F.col("base_credits") * F.col("g0") * F.col("g1")).alias("projected_credits"),
        )
        .withColumn("projected_cost_usd", F.col("projected_credits") * price)
    )


def scale_scenarios(
    run_rate: DataFrame, *, group_cols: Sequence[str] = (),
    scenarios: Sequence[tuple[str, float, float]] = tuple(S.SCALE_SCENARIOS),
    custom: tuple[float, float] | None = None,
) -> DataFrame:
    """Pilot to production: users and monthly cost under each scenario, from ``analytics.run_rate``."""
    rows = [*scenarios, *([("Custom", *custom)] if custom else [])]
    table = structs(["scenario", "user_multiplier", "usage_multiplier"], rows, ["string", "double", "double"])
    return (
        run_rate.withColumn("_s", F.explode(table))
        .select(
            *group_cols, "_s.*", "confidence_score", F.col("avg_users").alias("current_users"),
            F.col("monthly_cost").alias("current_monthly_cost"),
            (F.col("avg_users") * F.col("_s.user_multiplier")).alias("projected_users"),
            (F.col("monthly_cost") * F.col("_s.user_multiplier") * F.col("_s.usage_multiplier")).alias("projected_monthly_cost"),
        )
        .withColumn("projected_annual_cost", F.col("projected_monthly_cost") * 12)
        .withColumn("cost_per_user", ratio0("projected_monthly_cost", "projected_users"))
    )


def variance_for(confidence_score: Column, custom: float | None = None) -> Column:
    """Width of the confidence band: 30 % with no confidence down to 5 %."""
    if custom is not None:
        return F.lit(float(custom))
    return F.greatest(F.lit(0.05), F.lit(0.30) - confidence_score / 100 * 0.25)


def confidence_interval(df: DataFrame, value: str, *, variance: float | None = None) -> DataFrame:
    """Adds lower_bound, upper_bound and variance_pct around a column, from ``confidence_score``."""
    return (
        df.withColumn("variance_pct", variance_for(F.col("confidence_score"), variance))
        .withColumn("lower_bound", F.col(value) * (1 - F.col("variance_pct")))
        .withColumn("upper_bound", F.col(value) * (1 + F.col("variance_pct")))
    )


def budget_recommendation(scenario_costs: DataFrame, *, buffer: float = 1.15, group_cols: Sequence[str] = ()) -> DataFrame:
    """Upper bound of each scenario's annual cost plus a safety buffer."""
    return (
        confidence_interval(scenario_costs, "projected_annual_cost")
        .withColumn("recommended_annual_budget", F.col("upper_bound") * buffer)
        .withColumn("recommended_monthly_budget", F.col("recommended_annual_budget") / 12)
        .select(
            *group_cols, "scenario", "projected_annual_cost", "confidence_score", "lower_bound", "upper_bound",
            "recommended_annual_budget", "recommended_monthly_budget",
        )
    )


def budget_capacity(
    run_rate: DataFrame, *, monthly_budget: float, safety_buffer: float = 0.15, price: float = S.CREDIT_PRICE_USD,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """How many users a budget supports at the group's cost per user, from ``analytics.run_rate``."""
    usable = monthly_budget * (1 - safety_buffer)
    return (
        run_rate.withColumn("cost_per_user", ratio0("monthly_cost", "avg_users"))
        .withColumn("users_supported", F.when(F.col("cost_per_user") > 0, F.floor(F.lit(usable) / F.col("cost_per_user"))).cast("long"))
        .withColumn("used_budget", F.col("users_supported") * F.col("cost_per_user"))
        .select(
            *group_cols, "cost_per_user", "users_supported", "used_budget",
            (F.col("used_budget") / price).alias("total_monthly_credits"),
            (F.col("used_budget") / monthly_budget * 100).alias("utilisation_pct"),
            (F.lit(monthly_budget) - F.col("used_budget")).alias("remaining_budget"),
        )
    )
