"""Seasonal forecasts: level, trend and weekday season by exponential smoothing, and a backtest against simpler models.

A series is an array of its days, and the smoothing one pass over that array inside the engine (`aggregate`), so a series costs
one row, whatever its parameters. Every pair of a series and a set of smoothing parameters is a row; the set with the smallest
one-step-ahead error on the newest days is taken, and the band comes from these errors. Series are days, not usage records: a
hundred thousand series of a year are a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import structs

WEEK = 7
#: smoothing of the level; of the trend and the season as shares of it
ALPHAS, BETAS, GAMMAS = (0.1, 0.3, 0.5, 0.8), (0.0, 0.1, 0.3), (0.0, 0.2, 0.4)
#: number, alpha, beta, gamma, and the two products that the recursion uses
GRID = [
    (n, a, b, g, a * b, g * (1 - a)) for n, (a, b, g) in enumerate((a, b, g) for a in ALPHAS for b in BETAS for g in GAMMAS)
]
GRID_NAMES = ["set", "alpha", "beta", "gamma", "ab", "gs"]
OK, TOO_SHORT = "OK", "TOO_SHORT"
MODELS = ["seasonal", "linear", "last_week"]
ERROR = "decimal(28,9)"


def daily_arrays(series_days: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per series of (service_type, ts, y): first day and the array `ys` of all days, 0 for those without a row."""
    series = [*group_cols, "service_type"]
    days = series_days.select(*series, F.col("ts").cast("date").alias("day"), F.col("y").cast("double").alias("y"))
    following = F.lead("day").over(Window.partitionBy(*series).orderBy("day"))
    # a day is followed by the days that lack a row
    spread = days.withColumn("_last", F.coalesce(F.date_sub(following, 1), F.col("day"))).select(
        *series, F.posexplode(F.sequence("day", "_last")).alias("_gap", "day"), "y"
    )
    return spread.groupBy(*series).agg(
        F.min("day").alias("first_day"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("day", F.when(F.col("_gap") == 0, F.coalesce("y", F.lit(0.0))).otherwise(0.0).alias("y")))),
            lambda d: d["y"],
        ).alias("ys"),
    )


def _first_week(place: str) -> str:
    return " + ".join(place.format(i=i) for i in range(WEEK))


def smoothed(arrays: DataFrame, *, ys: str = "ys", group_cols: Sequence[str] = ()) -> DataFrame:
    """Each series with the best set of parameters, the state after its last day and the error `sigma` (one step ahead).

    The first two weeks set level, trend and season; the recursion starts in the second week. The held-back days, on which the
    sets are compared, are the newest fifth, seven at least. Series need three weeks.
    """
    series = [*group_cols, "service_type"]
    rest = "(y - (a.level + a.trend + a.season[0]))"
    start = (
        f"named_struct('t', {WEEK}, 'level', _mean, 'trend', _trend, 'season', transform(slice({ys}, 1, {WEEK}), y -> y - _mean), "
        f"'sse', 0D)"
    )
    step = (
        f"named_struct('t', a.t + 1, 'level', a.level + a.trend + alpha * {rest}, 'trend', a.trend + ab * {rest}, "
        f"'season', concat(slice(a.season, 2, {WEEK - 1}), array(a.season[0] + gs * {rest})), "
        f"'sse', a.sse + CASE WHEN a.t >= n - held THEN {rest} * {rest} ELSE 0D END)"
    )
    prepared = (
        arrays.withColumn("n", F.size(ys)).where(F.col("n") >= 3 * WEEK)
        .withColumn("held", F.greatest(F.lit(WEEK), F.floor(F.col("n") / 5).cast("int")))
        .withColumn("_mean", F.expr(f"({_first_week(ys + '[{i}]')}) / {WEEK}D"))
        .withColumn("_trend", F.expr(f"(({_first_week(ys + '[{i} + 7]')}) / {WEEK}D - _mean) / {WEEK}D"))
    )
    tried = prepared.select("*", F.inline(structs(GRID_NAMES, GRID, ["int"] + ["double"] * 5))).withColumn(
        "state", F.expr(f"aggregate(slice({ys}, {WEEK + 1}, n - {WEEK}), {start}, (a, y) -> {step})")
    )
    chosen = tried.groupBy(*series).agg(F.min_by(
        F.struct("n", "held", *GRID_NAMES, "state"), F.struct(F.col("state.sse").alias("sse"), "set")
    ).alias("best"))
    return chosen.select(*series, "best.*").withColumn("sigma", F.sqrt(F.col("state.sse") / F.col("held")))


def ahead(h: Column) -> Column:
    """Value of a smoothed series h days after its last one."""
    return F.col("state.level") + h * F.col("state.trend") + F.element_at("state.season", F.pmod(h - 1, F.lit(WEEK)).cast("int") + 1)


def widening(h: str = "h") -> str:
    """What errors of h - 1 unknown days add to the variance of day h, as a multiple of that of one step."""
    m, k = f"({h} - 1)", f"floor(({h} - 1) / {WEEK})"
    return (
        f"alpha * alpha * ({m} + beta * {m} * ({m} + 1) + beta * beta * {m} * ({m} + 1) * (2 * {m} + 1) / 6) "
        f"+ {k} * gs * gs + 2 * gs * (alpha * {k} + ab * {WEEK} * {k} * ({k} + 1) / 2)"
    )


def forecast_seasonal(series_days: DataFrame, *, horizon_days: int = 90, group_cols: Sequence[str] = ()) -> DataFrame:
    """Forecast with a 95 % band per series and day, with the parameters that were chosen.

    Days without a row count as days without usage. A series of fewer than 21 days is one row without a forecast, with the
    status TOO_SHORT. Forecast and lower bound do not fall below zero.
    """
    series = [*group_cols, "service_type"]
    arrays = daily_arrays(series_days, group_cols=group_cols)
    short = arrays.where(F.size("ys") < 3 * WEEK).select(*series, F.lit(TOO_SHORT).alias("status"))
    last = F.date_add("first_day", F.size("ys") - 1)
    days = (
        smoothed(arrays.withColumn("last_day", last), group_cols=group_cols)
        .join(arrays.select(*series, last.alias("last_day")), series)
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon_days))))
        .withColumn("_h", F.col("h").cast("double"))
        .withColumn("_value", ahead(F.col("_h")))
        .withColumn("_width", F.lit(1.96) * F.col("sigma") * F.sqrt(F.lit(1.0) + F.expr(widening("_h"))))
    )
    found = days.select(
        *series, F.date_add("last_day", F.col("h")).alias("forecast_date"),
        F.greatest(F.lit(0.0), F.col("_value")).alias("forecast_credits"),
        F.greatest(F.lit(0.0), F.col("_value") - F.col("_width")).alias("lower_bound_credits"),
        F.greatest(F.lit(0.0), F.col("_value") + F.col("_width")).alias("upper_bound_credits"),
        "alpha", "beta", "gamma", F.lit(OK).alias("status"),
    )
    return found.unionByName(short, allowMissingColumns=True)


def forecast_backtest(series_days: DataFrame, *, most_days: int = 28, group_cols: Sequence[str] = ()) -> DataFrame:
    """How far three models would have been off on the newest days of each series, knowing only the days before.

    The newest quarter of a series, `most_days` at most, is forecast by the seasonal model (its parameters chosen on the older
    days), by a straight line and by the last known week. One row per series and model: mean absolute error, mean error, and
    whether the model is the best one (ties: in the order above). Series whose older part has fewer than 21 days are left to
    the status of forecast_seasonal().
    """
    series = [*group_cols, "service_type"]
    cut = daily_arrays(series_days, group_cols=group_cols).withColumn(
        "tested", F.least(F.lit(most_days), F.floor(F.size("ys") / 4).cast("int"))
    ).withColumn("known", F.expr("slice(ys, 1, size(ys) - tested)"))
    line = (
        "aggregate(known, named_struct('x', 0D, 'sy', 0D, 'sxy', 0D), "
        "(a, y) -> named_struct('x', a.x + 1D, 'sy', a.sy + y, 'sxy', a.sxy + a.x * y))"
    )
    fitted = smoothed(cut, ys="known", group_cols=group_cols).select(*series, "state")
    days = (
        cut.join(fitted, series)
        .withColumn("_line", F.expr(line)).withColumn("_n", F.col("_line.x"))
        .withColumn("_sx", F.expr("_n * (_n - 1) / 2")).withColumn("_sxx", F.expr("_n * (_n - 1) * (2 * _n - 1) / 6"))
        .withColumn("_slope", F.expr("(_n * _line.sxy - _sx * _line.sy) / (_n * _sxx - _sx * _sx)"))
        .withColumn("_base", F.expr("(_line.sy - _slope * _sx) / _n"))
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.col("tested"))))
        .withColumn("_y", F.expr("ys[size(known) + h - 1]"))
    )
    values = [
        F.greatest(F.lit(0.0), ahead(F.col("h").cast("double"))),
        F.greatest(F.lit(0.0), F.expr("_base + _slope * (_n - 1 + h)")),
        F.expr(f"known[size(known) - {WEEK} + CAST(pmod(h - 1, {WEEK}) AS INT)]"),
    ]
    errors = days.select(*series, F.inline(F.array(*[
        F.struct(F.lit(place).alias("place"), F.lit(name).alias("model"), (F.col("_y") - value).alias("error"))
        for place, (name, value) in enumerate(zip(MODELS, values))
    ])))
    off, days_tested = F.col("error").cast(ERROR), F.count(F.lit(1))
    scored = errors.groupBy(*series, "place", "model").agg(
        days_tested.alias("days"), (F.sum(F.abs(off)).cast("double") / days_tested).alias("mean_absolute_error"),
        (F.sum(off).cast("double") / days_tested).alias("mean_error"),
    )
    best = F.row_number().over(Window.partitionBy(*series).orderBy("mean_absolute_error", "place")) == 1
    return scored.select(*series, "model", "days", "mean_absolute_error", "mean_error", best.alias("best"))
