"""Data-quality checks on the daily rollup. Each report is one aggregation pass per group."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import as_date, day_before, dbl, filled_text, mean, ts
from ..sources.schemas import TIME_COLUMN
from ..sources.telemetry import Telemetry

OLDEST_PLAUSIBLE = date(2020, 1, 1)


def _ratio_is_off() -> Column:
    users = F.col("daily_unique_users")
    expected = F.when(users > 0, dbl("total_credits") / users)
    return F.coalesce(F.abs(F.col("credits_per_user") - expected) > 0.01, F.lit(False))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def date_series(usage: DataFrame, *, group_cols: Sequence[str] = (), date_col: str = "usage_date") -> DataFrame:
    """Every calendar day from the first to the last day of each group."""
    return usage.groupBy(*group_cols).agg(
        F.min(date_col).alias("_first"), F.max(date_col).alias("_last")
    ).select(*group_cols, F.explode(F.sequence("_first", "_last")).alias("expected_date"))


def missing_dates(daily: DataFrame, *, as_of: datetime, days: int = 30, group_cols: Sequence[str] = ()) -> DataFrame:
    """Days of the last 30 without any row: their number and list. A group has at most 31 distinct days here."""
    start, end = F.lit(day_before(as_of, days)), F.lit(as_date(as_of))
    in_range = F.when(F.col("usage_date").between(start, end), F.col("usage_date"))
    missing = F.array_except(F.sequence(start, end), F.collect_set(in_range))
    return daily.groupBy(*group_cols).agg(
        F.size(missing).cast("long").alias("missing_count"),
        F.array_join(F.transform(missing, lambda d: d.cast("string")), ", ").alias("missing_dates"),
    )


def stale_services(daily: DataFrame, *, as_of: datetime, days: int = 7, group_cols: Sequence[str] = ()) -> DataFrame:
    age = F.datediff(F.lit(as_date(as_of)), F.col("last_data_date"))
    return (
        daily.groupBy(*group_cols, "service_type")
        .agg(F.max("usage_date").alias("last_data_date"))
        .withColumn("days_since_last_data", age.cast("long"))
        .where(F.col("days_since_last_data") > days)
    )


def null_counts(daily: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    columns = {
        "null_service_type": "service_type", "null_total_credits": "total_credits",
        "null_daily_users": "daily_unique_users", "null_operations": "total_operations",
    }
    return daily.groupBy(*group_cols).agg(*[F.count_if(F.col(c).isNull()).alias(n) for n, c in columns.items()])


def ratio_accuracy(daily: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows whose stored credits per user differ from the recomputed value, and the credits they carry."""
    return daily.groupBy(*group_cols).agg(
        _count(_ratio_is_off()).alias("error_count"),
        F.sum(F.when(_ratio_is_off(), F.col("total_credits"))).cast("double").alias("total_credits_affected"),
    )


def sum_consistency(daily: DataFrame, export: DataFrame, *, as_of: datetime, days: int = 30) -> DataFrame:
    """Credits of the rollup against credits of its export."""
    start = F.lit(day_before(as_of, days))
    both = (
        daily.where(F.col("usage_date") >= start).select(F.lit("summary").alias("side"), "total_credits")
        .unionByName(export.where(F.col("date") >= start).select(F.lit("export").alias("side"), "total_credits"))
    )

    def side(name: str) -> Column:
        return F.sum(F.when(F.col("side") == name, F.col("total_credits")))

    difference = F.abs(side("summary") - side("export"))
    return both.agg(
        side("summary").cast("double").alias("summary_credits"),
        side("export").cast("double").alias("export_credits"),
        difference.cast("double").alias("difference"),
        F.when(difference < 0.01, "PASS").otherwise(S.SUMS_DIFFER).alias("status"),
    )


def value_ranges(daily: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    credits, users = F.col("total_credits"), F.col("daily_unique_users")
    return daily.groupBy(*group_cols).agg(
        _count(credits < 0).alias("negative_credits"),
        _count(credits > 10000).alias("extremely_high_credits"),
        _count(users < 0).alias("negative_users"),
        _count(users > 10000).alias("extremely_high_users"),
        _count(F.col("total_operations") < 0).alias("negative_operations"),
    )


def date_validity(daily: DataFrame, *, as_of: datetime, group_cols: Sequence[str] = ()) -> DataFrame:
    return daily.groupBy(*group_cols).agg(
        _count(F.col("usage_date") > F.lit(as_date(as_of))).alias("future_dates"),
        _count(F.col("usage_date") < F.lit(OLDEST_PLAUSIBLE)).alias("dates_too_old"),
        F.min("usage_date").alias("earliest_date"),
        F.max("usage_date").alias("latest_date"),
    )


def unknown_services(
    daily: DataFrame, *, known: Sequence[str] = tuple(S.KNOWN_SERVICES), group_cols: Sequence[str] = ()
) -> DataFrame:
    return (
        daily.where(~F.col("service_type").isin(list(known)))
        .groupBy(*group_cols, "service_type")
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
    )


def duplicates(daily: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    return (
        daily.groupBy(*group_cols, "usage_date", "service_type")
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .where(F.col("duplicate_count") > 1)
    )


def _facts(daily: DataFrame, as_of: datetime, days: int, group_cols: Sequence[str]) -> DataFrame:
    """Everything score, recommendation and checks need, from one pass: rows first shrink to (day, service)."""
    start, end = day_before(as_of, days), as_date(as_of)
    per_key = daily.groupBy(*group_cols, "usage_date", "service_type").agg(
        F.count(F.lit(1)).alias("rows"),
        _count(_ratio_is_off()).alias("ratio_errors"),
        _count(F.col("total_credits") < 0).alias("negative_credits"),
        _count(F.col("daily_unique_users") < 0).alias("negative_users"),
    )
    recent_day = F.when(F.col("usage_date") >= F.lit(start), F.col("usage_date"))
    return per_key.groupBy(*group_cols).agg(
        F.count_distinct(recent_day).alias("recent_days"),
        F.count_distinct(F.when(F.col("usage_date").between(F.lit(start), F.lit(end)), F.col("usage_date"))).alias("covered_days"),
        F.sum("ratio_errors").alias("ratio_errors"),
        F.sum("negative_credits").alias("negative_credits"),
        F.sum("negative_users").alias("negative_users"),
        F.max("rows").alias("max_rows"),
        F.sum(F.when(F.col("service_type").isNull(), F.col("rows")).otherwise(0)).alias("null_services"),
        F.min("usage_date").alias("first_date"),
        F.max("usage_date").alias("last_date"),
    )


def quality_score(daily: DataFrame, *, as_of: datetime, days: int = 30, group_cols: Sequence[str] = ()) -> DataFrame:
    """Completeness, accuracy, validity and consistency (0-100 each), their mean and a rating."""
    recent = F.col("recent_days")
    facts = _facts(daily, as_of, days, group_cols)
    scores = facts.select(
        *group_cols,
        F.when(recent >= 25, F.lit(100.0)).otherwise(recent * F.lit(100.0) / 30).alias("completeness_score"),
        (100 - F.coalesce("ratio_errors", F.lit(0)) * 10).alias("accuracy_score"),
        (100 - (F.coalesce("negative_credits", F.lit(0)) + F.coalesce("negative_users", F.lit(0))) * 5).alias("validity_score"),
        F.when(F.col("max_rows") > 1, 50).otherwise(100).cast("long").alias("consistency_score"),
    )
    overall = (
        F.col("completeness_score") + F.col("accuracy_score") + F.col("validity_score") + F.col("consistency_score")
    ) / 4
    return scores.select(
        "*", F.round(overall, 2).alias("overall_quality_score"),
        F.when(overall >= 90, "EXCELLENT").when(overall >= 75, "GOOD").when(overall >= 60, "FAIR").otherwise("POOR")
        .alias("quality_rating"),
    )


def recommendation(daily: DataFrame, *, as_of: datetime, days: int = 30, group_cols: Sequence[str] = ()) -> DataFrame:
    """The most urgent finding."""
    return _facts(daily, as_of, days, group_cols).select(
        *group_cols,
        F.when(days + 1 - F.col("covered_days") > 5, S.ADVICE_MISSING_DATES)
        .when(F.col("ratio_errors") > 0, S.ADVICE_CALCULATION)
        .when(F.col("negative_credits") > 0, S.ADVICE_NEGATIVE)
        .otherwise(S.ADVICE_NONE).alias("recommendation"),
    )


def check_results(
    daily: DataFrame, *, as_of: datetime, run_ts: datetime, lookback_days: int = 90, group_cols: Sequence[str] = ()
) -> DataFrame:
    """One PASS, FAIL or WARN row per check, ready to be appended to a result table."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("string")

    in_range = (F.col("first_date") >= F.lit(day_before(as_of, lookback_days))) & (F.col("last_date") <= F.lit(as_date(as_of)))

    def passes(condition: Column, other: str = "FAIL") -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), "PASS").otherwise(other)

    def none(c: str) -> Column:
        return passes(F.coalesce(F.col(c), F.lit(0)) == 0)

    checks = [
        (7, "Data Quality", "No NULL service_type in daily summary", none("null_services"),
         F.concat(F.lit("Found "), text("null_services"), F.lit(" NULL service_type rows"))),
        (8, "Data Quality", "No negative credits in daily summary", none("negative_credits"),
         F.concat(F.lit("Found "), text("negative_credits"), F.lit(" rows with negative credits"))),
        (9, "Data Quality", "Dates within lookback window", passes(in_range, "WARN"),
         F.concat(F.lit("Date range: "), F.col("first_date").cast("string"), F.lit(" to "), F.col("last_date").cast("string"))),
        (10, "Data Quality", "No duplicate date-service combinations", passes(F.col("max_rows") == 1),
         F.concat(F.lit("Max occurrences per date-service: "), F.col("max_rows").cast("string"))),
        (11, "Business Logic", "credits_per_user calculated correctly", none("ratio_errors"),
         F.when(F.coalesce(F.col("ratio_errors"), F.lit(0)) == 0, "All calculations correct")
         .otherwise(F.concat(F.lit("Found "), text("ratio_errors"), F.lit(" rows with incorrect calculations")))),
    ]
    rows = F.array(*[
        F.struct(
            F.lit(number).alias("test_number"), F.lit(category).alias("test_category"), F.lit(name).alias("test_name"),
            status.alias("test_status"), message.alias("test_message"),
        )
        for number, category, name, status, message in checks
    ])
    return (
        _facts(daily, as_of, 30, group_cols)
        .select(*group_cols, F.explode(rows).alias("r"))
        .select(*group_cols, "r.*", F.lit(0.0).alias("execution_time_ms"), ts(run_ts).alias("tested_at"))
    )


#: view, and the column that dates its rows
CHECKED_VIEWS = {
    "analyst_detail": "usage_date", "search_detail": "usage_date", "daily_summary": "usage_date",
    "user_spend_attribution": "usage_date", "usage_history": "date", "usage_forecast": "forecast_date",
}


def run_checks(
    spark: SparkSession, *, as_of: datetime, run_ts: datetime, lookback_days: int = 90, prefix: str = "v_",
    checked: Mapping[str, str] = CHECKED_VIEWS,
) -> DataFrame:
    """All checks over the registered views (see ``views``), with the time that each has taken.

    The first checks read every row of a view, in one aggregate: rows, first and last date, rows without a date. A view that is
    missing or fails is a FAIL with the error, and the other checks go on. Each of the checks after them, made from one pass over
    the daily rollup, has that pass's time. The jobs run here; the result is a dozen rows.
    """
    out, columns = [], "test_number INT, test_category STRING, test_name STRING, test_status STRING, test_message STRING, execution_time_ms DOUBLE"

    def timed(action) -> tuple:
        start = time.perf_counter()
        try:
            found, error = action(), None
        except Exception as reason:  # a check reports what is wrong with a view, whatever it is
            found, error = None, str(reason).strip().splitlines()[0]
        return found, error, (time.perf_counter() - start) * 1000

    for number, (name, day) in enumerate(checked.items(), 1):
        facts, error, ms = timed(lambda: spark.table(prefix + name).agg(
            F.count(F.lit(1)).alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), F.count_if(F.col(day).isNull()).alias("undated"),
        ).first())
        if error is None:
            span = f" from {facts['first']} to {facts['last']}" if facts.n > facts.undated else ""
            undated = f", {facts.undated} without a date" if facts.undated else ""
            message = f"View accessible, returned {facts.n} rows{span}{undated}"
        else:
            message = f"Error: {error}"
        out.append((number, "Compilation", f"{name} can be read", "FAIL" if error else "PASS", message, ms))
    found, error, ms = timed(lambda: check_results(
        spark.table(f"{prefix}daily_summary"), as_of=as_of, run_ts=run_ts, lookback_days=lookback_days).collect())
    if error is None:
        out += [(r.test_number, r.test_category, r.test_name, r.test_status, r.test_message, ms) for r in found]
    else:
        out.append((7, "Data Quality", "The daily summary can be checked", "FAIL", f"Error: {error}", ms))
    return spark.createDataFrame(out, columns).withColumn("tested_at", ts(run_ts))


def check_summary(results: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """Passed, failed and warned checks by category."""
    status = F.col("test_status")
    return results.groupBy(*group_cols, "test_category").agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(status == "PASS").alias("passed"),
        F.count_if(status == "FAIL").alias("failed"),
        F.count_if(status == "WARN").alias("warnings"),
        F.round(mean("execution_time_ms"), 2).alias("avg_exec_time_ms"),
    )


def check_overall(results: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    status = F.col("test_status")
    failed = F.count_if(status == "FAIL")
    return results.groupBy(*group_cols).agg(
        F.when(failed == 0, S.CHECKS_PASSED).otherwise(filled_text(S.CHECKS_FAILED, n=failed)).alias("overall_status"),
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(status == "PASS").alias("passed"),
        failed.alias("failed"),
        F.count_if(status == "WARN").alias("warnings"),
    )


def export_stats(export: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    return export.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("date").alias("earliest_date"),
        F.max("date").alias("latest_date"),
        F.datediff(F.max("date"), F.min("date")).cast("long").alias("days_of_history"),
        F.count_distinct("service_type").alias("service_count"),
    )


def export_service_stats(export: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    return export.groupBy(*group_cols, "service_type").agg(
        F.count_distinct("date").alias("days_with_data"),
        F.round(F.sum("total_credits"), 8).alias("total_credits"),
        F.round(mean("daily_unique_users"), 2).alias("avg_daily_users"),
        F.round(mean(F.col("credits_per_operation").cast("decimal(28,12)")), 8).alias("avg_cost_per_operation"),
    )


def export_recent(export: DataFrame, *, as_of: datetime, days: int = 7, group_cols: Sequence[str] = ()) -> DataFrame:
    return export.where(F.col("date") >= F.lit(day_before(as_of, days))).select(
        *group_cols, "date", "service_type", F.round("total_credits", 8).alias("total_credits"), "total_operations"
    )


_COVERED = {
    S.ANALYST: ("analyst", "username"),
    S.SEARCH: ("search_daily", None),
    S.SEARCH_SERVING: ("search_serving", None),
    S.FUNCTIONS: ("functions", "user_id"),
    S.DOCUMENT_LEGACY: ("documents_legacy", None),
    S.DOCUMENTS: ("documents", None),
    S.FINE_TUNING: ("fine_tuning", None),
}


def source_coverage(t: Telemetry) -> DataFrame:
    """One row per usage table: records, first and last time, and records that name their user (0 where the table has
    no user column)."""
    parts = []
    for service, (name, user) in _COVERED.items():
        time = F.col(TIME_COLUMN[name])
        parts.append(
            getattr(t, name).agg(
                F.lit(service).alias("service"),
                F.count(F.lit(1)).alias("records"),
                F.min(time).cast("timestamp_ntz").alias("earliest"),
                F.max(time).cast("timestamp_ntz").alias("latest"),
                (F.count(user) if user else F.lit(0)).cast("long").alias("records_with_user"),
            )
        )
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every
