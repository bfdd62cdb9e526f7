"""Week-over-week cost anomalies on the daily rollup. Windows run over days, never over usage records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import day_before, dbl, filled_text, mean_over, pct_change, whole_percent_text, windowed


def cost_anomalies(
    daily: DataFrame,
    *,
    as_of: datetime,
    lookback_days: int = 90,
    group_cols: Sequence[str] = (),
    high: float | Column = 0.50,
    medium: float | Column = 0.25,
    calendar: bool = False,
) -> DataFrame:
    """Compare each day with the row 7 and 14 rows earlier and with the mean of the last 7 rows of its service.

    With ``calendar`` the same comparisons count days, so gaps do not shift them. Days without a value a week earlier
    are dropped. A falling day is DECLINING at any rate, but its message and action change only below -medium. The bounds may
    be columns of ``daily``, as where every account has its own.
    """
    series = [*group_cols, "service_type"]
    recent = daily.where(F.col("usage_date") >= F.lit(day_before(as_of, lookback_days))).select(
        F.col("usage_date").alias("date"), *series, "total_credits", "daily_unique_users", "total_operations",
        *[bound.alias(name) for name, bound in (("_high", high), ("_medium", medium)) if isinstance(bound, Column)],
    )
    high, medium = (F.col(n) if isinstance(b, Column) else b for n, b in (("_high", high), ("_medium", medium)))
    if calendar:
        by_day = windowed(series, F.datediff("date", F.lit("1970-01-01").cast("date")))

        def earlier(n: int) -> Column:
            return F.max("total_credits").over(by_day.rangeBetween(-n, -n))

        last_week = by_day.rangeBetween(-6, 0)
    else:
        by_day = windowed(series, F.col("date"))

        def earlier(n: int) -> Column:
            return F.lag("total_credits", n).over(by_day)

        last_week = by_day.rowsBetween(-6, 0)

    compared = (
        recent.withColumns({
            "credits_7d_ago": earlier(7),
            "credits_14d_ago": earlier(14),
            "credits_7d_avg": mean_over("total_credits", last_week),
        })
        .where(F.col("credits_7d_ago").isNotNull())
        .withColumns({
            "_pct": pct_change("total_credits", "credits_7d_ago"),
            "_growth": (dbl("total_credits") - dbl("credits_7d_ago")) / F.nullif(dbl("credits_7d_ago"), F.lit(0.0)),
        })
    )
    growth = F.col("_growth")

    def text(place: int) -> Column:
        def of(level: str) -> Column:
            pct = whole_percent_text(F.abs("_pct"))
            return filled_text(S.ALERT_TEXTS[level][place], service=F.col("service_type"), pct=pct)

        return F.when(growth > high, of("HIGH")).when(growth > medium, of("MEDIUM")).when(
            growth < -medium, of("DECLINING")
        ).otherwise(of("NORMAL"))

    level = F.when(growth > high, "HIGH").when(growth > medium, "MEDIUM").when(growth < 0, "DECLINING")
    return compared.select(
        "date", *series, "total_credits", "credits_7d_ago", "credits_14d_ago", "credits_7d_avg",
        "daily_unique_users", "total_operations",
        F.round("_pct", 2).alias("wow_growth_pct"),
        F.round(F.col("total_credits") - F.col("credits_7d_ago"), 4).alias("wow_credits_change"),
        F.round(pct_change("total_credits", "credits_14d_ago"), 2).alias("two_week_growth_pct"),
        F.round(pct_change("total_credits", "credits_7d_avg"), 2).alias("deviation_from_avg_pct"),
        level.otherwise("NORMAL").alias("alert_level"),
        text(0).alias("alert_message"),
        text(1).alias("recommended_action"),
    )


def refresh_anomalies(
    stored: DataFrame, daily: DataFrame, changed: DataFrame, *, as_of: datetime, lookback_days: int = 90,
    group_cols: Sequence[str] = (), high: float = 0.50, medium: float = 0.25, calendar: bool = False,
) -> DataFrame:
    """Stored anomalies after some days of the rollup have come late, changed or gone, without computing the others again.

    ``changed`` names these days (usage_date and the columns of a series). A changed day can only touch the day itself and the
    14 rows (or days, with ``calendar``) after it. These are computed from themselves and the 14 rows before them, and take the
    place of what is stored; the result equals cost_anomalies() over all days. ``as_of`` and the bounds are those that the
    stored rows were made with.
    """
    series = [*group_cols, "service_type"]
    reach = 14
    days = daily.where(F.col("usage_date") >= F.lit(day_before(as_of, lookback_days)))
    marks = changed.select(*series, "usage_date").distinct()
    both = days.withColumn("_mark", F.lit(0)).unionByName(marks.withColumn("_mark", F.lit(1)), allowMissingColumns=True)
    # a mark stands before the row of its day
    whole = windowed(series, F.col("usage_date"), F.desc("_mark"))
    if calendar:
        since = F.datediff("usage_date", F.max(F.when(F.col("_mark") == 1, F.col("usage_date"))).over(whole))
        until = F.datediff(F.min(F.when(F.col("_mark") == 1, F.col("usage_date"))).over(whole.rowsBetween(0, Window.unboundedFollowing)), "usage_date")
        touched = since <= reach
        # days of the two weeks before a touched day: at most two weeks before a mark, or two weeks before its last touched day
        needed = touched | (since <= 2 * reach) | (until <= reach)
        placed = both.withColumn("_touched", F.coalesce(touched, F.lit(False))).withColumn("_needed", F.coalesce(needed, F.lit(False)))
    else:
        row = F.sum(1 - F.col("_mark")).over(whole)
        placed = both.withColumn("_row", row).withColumn(
            "_touched", F.coalesce(F.col("_row") - F.last(F.when(F.col("_mark") == 1, F.col("_row")), True).over(whole) <= reach + 1, F.lit(False)))
        following = windowed(series, F.col("usage_date"), F.desc("_mark")).rowsBetween(0, Window.unboundedFollowing)
        # the first touched row from here on, as a row has it: rows up to 14 before it are read
        next_touched = F.min(F.when(F.col("_touched") & (F.col("_mark") == 0), F.col("_row"))).over(following)
        placed = placed.withColumn("_needed", F.coalesce(next_touched - F.col("_row") <= reach, F.lit(False)))
    part = placed.where((F.col("_mark") == 0) & F.col("_needed"))
    again = cost_anomalies(
        part, as_of=as_of, lookback_days=lookback_days, group_cols=group_cols, high=high, medium=medium, calendar=calendar)
    gone = placed.where(F.col("_touched") | (F.col("_mark") == 1)).select(*series, F.col("usage_date").alias("date")).distinct()

    def same(other: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(other[c]) for c in [*series, "date"]])

    fresh = again.alias("s").join(gone, same(gone), "left_semi")
    return stored.alias("s").join(gone, same(gone), "left_anti").unionByName(fresh)


def cost_anomalies_current(anomalies: DataFrame, *, as_of: datetime, days: int = 7, group_cols: Sequence[str] = ()) -> DataFrame:
    level = F.col("alert_level")
    return anomalies.where((F.col("date") >= F.lit(day_before(as_of, days))) & level.isin("HIGH", "MEDIUM")).select(
        "date", *group_cols, "service_type", "total_credits", "credits_7d_ago", "wow_growth_pct", "wow_credits_change",
        "alert_level", "alert_message", "recommended_action", "daily_unique_users",
        F.coalesce(F.create_map(*[F.lit(x) for kv in S.ALERT_PRIORITY.items() for x in kv])[level], F.lit(0))
        .cast("long").alias("priority_score"),
    )


def cost_anomaly_summary(anomalies: DataFrame, *, as_of: datetime, days: int = 30, group_cols: Sequence[str] = ()) -> DataFrame:
    recent = anomalies.where(
        (F.col("date") >= F.lit(day_before(as_of, days))) & F.col("alert_level").isin("HIGH", "MEDIUM", "DECLINING")
    )
    pct = F.col("wow_growth_pct").cast("decimal(20,2)")
    services = F.array_sort(F.collect_set("service_type"))  # as many entries as there are services
    return recent.groupBy(*group_cols, "alert_level").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.size(services).cast("long").alias("affected_services"),
        (F.sum(pct).cast("double") / F.count(pct)).alias("avg_growth_pct"),
        F.max("wow_growth_pct").alias("max_growth_pct"),
        F.sum("wow_credits_change").alias("total_credits_change"),
        F.min("date").alias("first_occurrence"),
        F.max("date").alias("last_occurrence"),
        F.array_join(services, ", ").alias("services_list"),
    )


def anomaly_status(current: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return current.agg(
        n.alias("active_anomalies"),
        F.when(n == 0, S.ALERTS_NONE).otherwise(filled_text(S.ALERTS_SOME, n=n)).alias("current_status"),
    )


def anomaly_top(current: DataFrame, *, k: int = 10) -> DataFrame:
    """The newest alerts, most urgent first within a day."""
    return (
        current.orderBy(
            F.desc("date"), F.desc("priority_score"), F.desc_nulls_first("wow_growth_pct"), "service_type"
        )
        .limit(k)
        .select(
            "date", "service_type", "total_credits", "credits_7d_ago", "wow_growth_pct", "alert_level",
            "alert_message", "recommended_action",
        )
    )


def anomaly_digest(current: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """All current messages of a group in one text: at most one message per service and day of the alert window."""
    entries = F.array_sort(F.collect_list(F.struct("date", "service_type", "alert_message")))
    texts = F.transform(entries, lambda e: e["alert_message"])
    return current.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("alert_count"), F.array_join(texts, "; ").alias("alert_digest")
    )
