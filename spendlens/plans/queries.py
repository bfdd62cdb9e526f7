"""One registered query per operator, on usage tables derived from the driver's test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import services as S
from ..functions.columns import day_before, long_lit, present, ts
from ..operators import (
    active_users, analytics, anomalies, attribution, details, extras, forecast, quality, quantiles, rollups, seasonal,
    settings, snapshot,
)
from ..session import scratch_path
from ..sources import usage_files, versions
from ..sources.schemas import SNAPSHOT_SCHEMA, struct
from ..streaming import daily_usage as stream
from . import testbed
from .testbed import AS_OF, LOOKBACK_DAYS

SCOPE = {"as_of": AS_OF, "lookback_days": LOOKBACK_DAYS}
RUN_TS = datetime(2024, 1, 31, 3, 0)
ACCOUNT = ("account",)
MODELS = ["claude-3-haiku", "in-house-1", "llama3.1-405b", "llama3.1-70b", "mistral-7b"]
SNAPSHOT_SERVICES = [S.ANALYST, S.DOCUMENTS, S.FINE_TUNING, S.FUNCTION_MODELS, S.SEARCH]


class Bed:
    """Inputs of the registered queries; every frame is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def telemetry(self):
        return testbed.telemetry(self.spark, self.sf_dir)

    @cached_property
    def daily(self):
        return rollups.daily_summary(self.telemetry, **SCOPE)

    @cached_property
    def export(self):
        return rollups.cost_export(self.daily)

    @cached_property
    def accounts(self):
        return testbed.account_usage(self.spark, self.sf_dir)

    @cached_property
    def account_days(self):
        """Account usage in the layout of the daily rollup."""
        return rollups.with_ratios(self.accounts.withColumnRenamed("date", "usage_date"))

    @cached_property
    def faulty_days(self):
        return self.account_days.selectExpr(*testbed.FAULTY_DAYS)

    @cached_property
    def faulty_checks(self):
        return quality.check_results(self.faulty_days, as_of=AS_OF, run_ts=RUN_TS)

    @cached_property
    def attribution(self):
        return attribution.user_spend_attribution(self.telemetry, **SCOPE)

    @cached_property
    def functions(self):
        return rollups.function_summary(self.telemetry, **SCOPE)

    @cached_property
    def models(self):
        return rollups.model_comparison(self.telemetry, **SCOPE)

    @cached_property
    def trends(self):
        return rollups.function_daily_trends(self.telemetry, **SCOPE)

    @cached_property
    def snapshots(self):
        return snapshot.backfill_snapshots(self.telemetry, **SCOPE)

    @cached_property
    def history(self):
        return snapshot.usage_history(self.snapshots)

    @cached_property
    def anomalies(self):
        return anomalies.cost_anomalies(self.daily, **SCOPE)

    @cached_property
    def current(self):
        return anomalies.cost_anomalies_current(self.anomalies, as_of=AS_OF)

    @cached_property
    def account_anomalies(self):
        return anomalies.cost_anomalies(self.account_days, **SCOPE, group_cols=ACCOUNT)

    @cached_property
    def account_current(self):
        return anomalies.cost_anomalies_current(self.account_anomalies, as_of=AS_OF, group_cols=ACCOUNT)

    @cached_property
    def forecast(self):
        return forecast.forecast_12m(self.series)

    @cached_property
    def series(self):
        """What the newest snapshots hold, taken from the rollup that they store."""
        return forecast.forecast_input(snapshot.usage_by_feature(self.telemetry, **SCOPE), as_of=AS_OF)

    @cached_property
    def account_series(self):
        """Daily credits per account and service; some series are short, most have days without usage."""
        young = (F.col("account") == "acct_9") & (F.col("date") < F.lit(day_before(AS_OF, 15)))
        return self.accounts.where(~young).select(*ACCOUNT, "service_type", F.col("date").alias("ts"), F.col("total_credits").alias("y"))

    @cached_property
    def forecast_months(self):
        return forecast.forecast_by_month(self.forecast, horizon_days=180)

    @cached_property
    def projection(self):
        return forecast.growth_projection(self.accounts, growth_rate=0.25, group_cols=ACCOUNT)

    @cached_property
    def band(self):
        return forecast.growth_monthly_band(self.projection, group_cols=ACCOUNT)

    @cached_property
    def run_rate(self):
        return analytics.run_rate(self.accounts, group_cols=ACCOUNT)

    @cached_property
    def scenarios(self):
        return forecast.scale_scenarios(self.run_rate, group_cols=ACCOUNT)

    @cached_property
    def maturity(self):
        return analytics.data_maturity(self.accounts, group_cols=ACCOUNT)

    @cached_property
    def executive(self):
        return analytics.executive_summary(self.accounts, group_cols=ACCOUNT)

    @cached_property
    def breakdown(self):
        return analytics.service_breakdown(self.accounts, group_cols=ACCOUNT)

    @cached_property
    def rolling(self):
        return analytics.rolling_30d(self.accounts, group_cols=ACCOUNT)

    @cached_property
    def latest(self):
        return analytics.latest_rolling_30d(self.rolling, group_cols=ACCOUNT)

    @cached_property
    def baseline(self):
        return analytics.request_baseline(self.accounts, group_cols=ACCOUNT)

    @cached_property
    def personas(self):
        return analytics.persona_costs(self.baseline, group_cols=ACCOUNT)

    @cached_property
    def uploaded(self):
        return testbed.uploaded_usage(self.spark, self.sf_dir)

    @cached_property
    def checks(self):
        return quality.check_results(self.daily, as_of=AS_OF, run_ts=RUN_TS)

    @cached_property
    def stored_settings(self):
        return testbed.stored_settings(self.spark, self.sf_dir)

    @cached_property
    def merged_settings(self):
        owners = testbed.table(self.spark, self.sf_dir, "customer").selectExpr("c_custkey AS account")
        return settings.config_upsert(
            self.stored_settings, settings.config_defaults(owners, deployed_at=RUN_TS), run_ts=RUN_TS, run_by="deploy", group_cols=ACCOUNT
        )

    @cached_property
    def documents(self):
        return testbed.table(self.spark, self.sf_dir, "documents")


def _csv_round_trip(b: Bed, compression: str) -> DataFrame:
    path = scratch_path(b.spark, "usage-csv")
    usage_files.write_csv(b.accounts, path, compression=compression)
    return usage_files.read_usage_csv(b.spark, path).drop("bad_date", "bad_credits")


def _snapshot_upsert(b: Bed) -> DataFrame:
    """Second run of a day's job: the table holds the day before, and stale rows of a first run that had not yet seen
    the newest day."""
    source, yesterday = snapshot.snapshot_source(b.telemetry, as_of=AS_OF), AS_OF - timedelta(days=1)
    before = snapshot.snapshot_source(b.telemetry, as_of=yesterday).withColumn("inserted_at", ts(yesterday + timedelta(hours=3)))
    stale = (
        source.where(F.col("usage_date") < F.lit(yesterday.date()))
        .withColumn("total_operations", long_lit(0)).withColumn("inserted_at", ts(AS_OF + timedelta(hours=2)))
    )
    return snapshot.snapshot_upsert(before.unionByName(stale), source, run_ts=RUN_TS)


def _snapshot_job(b: Bed) -> DataFrame:
    """The stored form of the daily job: run, run again, read back."""
    path = scratch_path(b.spark, "snapshot-job")
    for _ in range(2):
        snapshot.run_daily_snapshot(b.telemetry, path, as_of=AS_OF, run_ts=RUN_TS)
    return b.spark.read.schema(struct(SNAPSHOT_SCHEMA)).parquet(path)


def _snapshot_published(b: Bed) -> DataFrame:
    """The daily job of two days in a table whose states are published, the second day twice."""
    root = scratch_path(b.spark, "snapshot-published")
    for day in (AS_OF - timedelta(days=1), AS_OF, AS_OF):
        snapshot.run_daily_snapshot(b.telemetry, root, as_of=day, run_ts=RUN_TS, publish=True)
    return versions.read_published(b.spark, root, struct(SNAPSHOT_SCHEMA), [str(AS_OF.date())])


def _search_long_tokens(b: Bed) -> DataFrame:
    """Search usage whose token texts have more digits than a BIGINT holds."""
    long = b.telemetry.search_daily.withColumn("tokens", F.concat("tokens", F.lit("7" * 16)))
    detail = details.search_detail(b.telemetry.replace(search_daily=long), **SCOPE)
    return detail.groupBy("service_name", "consumption_type").agg(
        F.sum("tokens").cast("string").alias("tokens"), F.count("tokens").alias("numbers"))


def _checks_of_views(b: Bed, faulty: bool) -> DataFrame:
    """All checks over the views; the faulty variant has a view that is missing and one that fails when it is read.

    Each check is a job of its own, and five read the usage of functions and documents. These are joins here, whose tables would
    be shuffled for every check, so they are made once. In the faulty variant only two read them: storing would cost more.
    """
    prefix, telemetry = "faulty_" if faulty else "checked_", b.telemetry
    if not faulty:
        try:
            telemetry = telemetry.stored(scratch_path(b.spark, "checked-telemetry"), "functions", "documents")
        except Exception:  # a table that can't be made is reported by the checks that need it
            telemetry = b.telemetry
    views.register_views(b.spark, telemetry, **SCOPE, prefix=prefix)
    if faulty:
        b.spark.catalog.dropTempView(f"{prefix}search_detail")
        b.faulty_days.selectExpr("*", "1 AS credits_per_operation").createOrReplaceTempView(f"{prefix}daily_summary")
        b.spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW {prefix}usage_history AS
                        SELECT raise_error('broken') AS d, CAST(raise_error('broken') AS DATE) AS date FROM {prefix}analyst_detail""")
    found = quality.run_checks(b.spark, as_of=AS_OF, run_ts=RUN_TS, prefix=prefix)
    # the error texts are the engine's own
    message = F.when(F.col("test_message").startswith("Error: "), "Error").otherwise(F.col("test_message"))
    return found.select(
        "test_number", "test_category", "test_name", "test_status", message.alias("test_message"), (F.col("execution_time_ms") > 0).alias("timed"))


def _check_results_stored(b: Bed) -> DataFrame:
    """Stored twice under the name of the run, as when a run is repeated."""
    path = scratch_path(b.spark, "check-results")
    for _ in range(2):
        usage_files.append_results(b.checks, path, run=RUN_TS.isoformat())
    return b.spark.read.schema(b.checks.schema).parquet(path).drop("run")


def _lookback_scan(b: Bed) -> DataFrame:
    return b.telemetry.recent("analyst", AS_OF, 7)


def _snapshot_or_live(b: Bed) -> DataFrame:
    """The snapshot table lacks two services, which are then taken from the live rollup."""
    stored = b.history.where(~F.col("service_type").isin(S.SEARCH, S.FUNCTION_MODELS)).select(
        "date", "service_type", "daily_unique_users", "total_operations", "total_credits", "credits_7d_ago",
        "credits_wow_growth_pct",
    )
    return usage_files.snapshot_or_live(stored, b.export)


def _rate_card_join(b: Bed) -> DataFrame:
    return analytics.rate_card_join(b.functions, *analytics.rate_card(b.spark))


def _streamed(b: Bed, **options) -> DataFrame:
    """The events as several files, each with events of all days in no order, one file to a batch."""
    source = scratch_path(b.spark, "stream-source")
    testbed.table(b.spark, b.sf_dir, "events").repartition(4, F.pmod(F.hash("user_id", "ts"), F.lit(4))).write.parquet(source)
    schema = b.spark.read.parquet(source).schema
    events = b.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    usage = events.selectExpr(
        "CAST(ts AS TIMESTAMP) AS event_time", "event_type AS service_type", "user_id AS user",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS operations", "CAST(value / 100 AS DECIMAL(18,6)) AS credits",
    )
    path, parts, checkpoint = (scratch_path(b.spark, f"stream-{n}") for n in ("table", "parts", "checkpoint"))
    stream.start_daily_usage(usage, path=path, parts=parts, checkpoint=checkpoint, availableNow=True, **options).awaitTermination()
    return b.spark.read.parquet(path).select("usage_date", "service_type", "events", "users", "total_operations", "total_credits")


def _stream_sketched(b: Bed) -> DataFrame:
    """Sums are exact; users, estimated by sketches, are held against their exact number."""
    exact = testbed.table(b.spark, b.sf_dir, "events").groupBy(
        F.col("ts").cast("date").alias("usage_date"), F.col("event_type").alias("service_type")
    ).agg(F.count_distinct("user_id").alias("exact_users"))
    off = F.abs(F.col("users") - F.col("exact_users")) / F.col("exact_users")
    return _streamed(b, users="sketch", closed_days=3).join(exact, ["usage_date", "service_type"]).select(
        "usage_date", "service_type", "events", "total_operations", "total_credits", "exact_users",
        (off <= 5 * 1.04 / 2 ** (stream.SKETCH_BITS / 2)).alias("estimate_within_five_errors"),
    )


def _anomalies_configured(b: Bed) -> DataFrame:
    settings.register_get_config(b.spark, testbed.threshold_overrides(b.spark, b.sf_dir))
    return anomalies.cost_anomalies(
        b.account_days, **SCOPE, group_cols=ACCOUNT, high=settings.configured_number("ANOMALY_THRESHOLD_HIGH"),
        medium=settings.configured_number("ANOMALY_THRESHOLD_MEDIUM"),
    )


def _anomalies_refreshed(b: Bed) -> DataFrame:
    """Anomalies from days of which some were missing, wrong or too many, refreshed by the days that have changed."""
    late, wrong = F.dayofmonth("usage_date") % 11 == 3, (F.col("account") == "acct_5") & (F.dayofmonth("usage_date") == 20)
    extra = b.account_days.where(F.dayofmonth("usage_date") == 9).withColumn("service_type", F.lit("Moved"))
    before = b.account_days.where(~late).withColumn(
        "total_credits", F.when(wrong, F.col("total_credits") / 2).otherwise(F.col("total_credits")).cast(b.account_days.schema["total_credits"].dataType)
    ).unionByName(extra)
    stored = anomalies.cost_anomalies(before, **SCOPE, group_cols=ACCOUNT)
    changed = b.account_days.where(late | wrong).unionByName(extra)
    return anomalies.refresh_anomalies(stored, b.account_days, changed, **SCOPE, group_cols=ACCOUNT)


def _sql_over_views(b: Bed) -> DataFrame:
    """Alerts and users by service in SQL text: anomalies and export over the rollup, active users over the attribution."""
    views.register_views(b.spark, b.telemetry, **SCOPE, prefix="bed_")
    return b.spark.sql("""
        WITH alert AS (
          SELECT date, service_type FROM bed_cost_anomalies WHERE alert_level IN ('HIGH', 'MEDIUM')
        )
        SELECT e.service_type, COUNT(*) AS days, SUM(e.total_credits) AS total_credits, COUNT(a.date) AS alerts,
               MAX(u.users_30d) AS most_users_30d
        FROM bed_cost_export e LEFT JOIN alert a ON a.date = e.date AND a.service_type = e.service_type
        LEFT JOIN bed_active_users u ON u.usage_date = e.date AND u.service_type = e.service_type
        WHERE e.date >= DATE'2023-12-01' GROUP BY e.service_type HAVING SUM(e.total_credits) > 0""")


def _model_quantiles(b: Bed) -> DataFrame:
    """Quantiles of December from the summaries of its days; their ranks are held against the records."""
    days = {"first": date(2023, 12, 1), "last": date(2023, 12, 31)}
    answers = quantiles.credit_quantiles(quantiles.credit_summaries(b.telemetry, **SCOPE), **days)
    checked = quantiles.rank_errors(answers, b.telemetry, **days)
    return checked.select("model_name", "records", "exact_records", *[
        (F.col(f"{n}_rank_error") <= 3 * quantiles.RANK_ERROR).alias(f"{n}_in_rank") for n in quantiles.QUANTILES
    ])


Query = Callable[[Bed], DataFrame]

QUERIES: dict[str, Query] = {
    # sources and sinks
    "lookback_scan": _lookback_scan,
    "csv_ingest": lambda b: _csv_round_trip(b, "none"),
    "csv_ingest_gzip": lambda b: _csv_round_trip(b, "gzip"),
    "csv_validation_report": lambda b: usage_files.validation_report(b.uploaded, group_cols=ACCOUNT),
    "csv_validated_rows": lambda b: usage_files.validate_usage(b.uploaded, group_cols=ACCOUNT)[0],
    "snapshot_or_live": _snapshot_or_live,
    "user_spend_window": lambda b: attribution.user_spend_window(b.attribution, as_of=AS_OF),
    "export_realtime": lambda b: usage_files.export_realtime(b.export, as_of=AS_OF),
    "export_snapshot": lambda b: usage_files.export_snapshot(b.history, as_of=AS_OF),
    "export_function_detail": lambda b: usage_files.export_function_detail(b.functions),
    "snapshot_upsert": _snapshot_upsert,
    "config_upsert": lambda b: b.merged_settings,
    "config_value": lambda b: settings.config_value(b.merged_settings, "CREDIT_COST_USD", group_cols=ACCOUNT),
    "config_typed": lambda b: settings.config_typed(b.merged_settings, group_cols=ACCOUNT),
    "config_summary": lambda b: settings.config_summary(b.merged_settings, group_cols=ACCOUNT),
    "date_series": lambda b: quality.date_series(b.daily, group_cols=("service_type",)),
    # per-service detail
    "analyst_detail": lambda b: details.analyst_detail(b.telemetry, **SCOPE),
    "search_detail": lambda b: details.search_detail(b.telemetry, **SCOPE),
    "search_serving_detail": lambda b: details.search_serving_detail(b.telemetry, **SCOPE),
    "search_long_tokens": _search_long_tokens,
    "functions_detail": lambda b: details.functions_detail(b.telemetry, **SCOPE),
    "functions_query_detail": lambda b: details.functions_query_detail(b.telemetry, **SCOPE),
    "document_legacy_detail": lambda b: details.document_legacy_detail(b.telemetry, **SCOPE),
    "document_detail": lambda b: details.document_detail(b.telemetry, **SCOPE),
    "fine_tuning_detail": lambda b: details.fine_tuning_detail(b.telemetry, **SCOPE),
    # rollups and attribution
    "function_summary": lambda b: b.functions,
    "model_comparison": lambda b: b.models,
    "model_credit_quantiles": _model_quantiles,
    "function_daily_trends": lambda b: b.trends,
    "query_cost_analysis": lambda b: rollups.query_cost_analysis(b.telemetry, **SCOPE),
    "top_queries": lambda b: rollups.top_queries(b.telemetry, k=10, **SCOPE),
    "user_spend_attribution": lambda b: b.attribution,
    "user_spend_summary": lambda b: attribution.user_spend_summary(b.attribution),
    "active_users_sliding": lambda b: active_users.active_users_sliding(b.attribution, as_of=AS_OF.date()),
    "user_feature_usage": lambda b: attribution.user_feature_usage(b.attribution),
    "daily_summary": lambda b: b.daily,
    "cost_export": lambda b: b.export,
    "metering_ai_services": lambda b: rollups.metering_by_service(b.telemetry, **SCOPE),
    # snapshots, history, anomalies
    "unmatched_documents": lambda b: snapshot.unmatched_documents(b.telemetry, **SCOPE),
    "snapshot_job": _snapshot_job,
    "snapshot_published": _snapshot_published,
    "snapshot_source": lambda b: snapshot.snapshot_source(b.telemetry, as_of=AS_OF),
    "snapshot_source_repeated": lambda b: snapshot.snapshot_source(b.telemetry, as_of=AS_OF, repeat_functions=True),
    "snapshot_backfill": lambda b: b.snapshots,
    "usage_history": lambda b: b.history,
    "usage_history_calendar": lambda b: snapshot.usage_history(b.snapshots, calendar=True).select(
        "date", "service_type", "total_credits", "credits_7d_ago", "credits_wow_growth_pct"
    ),
    "cost_anomalies": lambda b: b.anomalies,
    "cost_anomalies_calendar": lambda b: anomalies.cost_anomalies(
        b.account_days, **SCOPE, group_cols=ACCOUNT, high=0.60, medium=0.30, calendar=True
    ),
    "cost_anomalies_configured": _anomalies_configured,
    "cost_anomalies_refreshed": _anomalies_refreshed,
    "cost_anomalies_current": lambda b: b.account_current,
    "cost_anomaly_summary": lambda b: anomalies.cost_anomaly_summary(b.account_anomalies, as_of=AS_OF, group_cols=ACCOUNT),
    "anomaly_status": lambda b: anomalies.anomaly_status(b.current),
    "anomaly_top10": lambda b: anomalies.anomaly_top(b.current),
    "anomaly_digest": lambda b: anomalies.anomaly_digest(b.account_current, group_cols=ACCOUNT),
    # forecasts and projections
    "forecast_input": lambda b: b.series,
    "forecast_12m": lambda b: b.forecast,
    "linear_forecast": lambda b: forecast.linear_forecast(b.accounts, months=3, group_cols=ACCOUNT),
    "linear_forecast_monthly": lambda b: forecast.linear_forecast_monthly(
        forecast.linear_forecast(b.accounts, group_cols=ACCOUNT), group_cols=ACCOUNT
    ),
    "forecast_by_month": lambda b: b.forecast_months,
    "forecast_monthly": lambda b: forecast.forecast_monthly(b.forecast_months),
    "forecast_pivot": lambda b: forecast.forecast_pivot(b.forecast_months, services=SNAPSHOT_SERVICES),
    "forecast_seasonal": lambda b: seasonal.forecast_seasonal(b.account_series, horizon_days=60, group_cols=ACCOUNT),
    "forecast_backtest": lambda b: seasonal.forecast_backtest(b.account_series, group_cols=ACCOUNT),
    "growth_projection": lambda b: b.projection,
    "growth_monthly_band": lambda b: b.band,
    "growth_cards": lambda b: forecast.growth_cards(b.band, group_cols=ACCOUNT),
    "growth_scenarios": lambda b: forecast.growth_scenarios(b.accounts, group_cols=ACCOUNT),
    "growth_two_driver": lambda b: forecast.growth_two_driver(
        b.accounts, user_growth=0.10, intensity_growth=0.05, months=6, group_cols=ACCOUNT
    ),
    "scale_scenarios": lambda b: b.scenarios,
    "budget_recommendation": lambda b: forecast.budget_recommendation(b.scenarios, group_cols=ACCOUNT),
    "budget_capacity": lambda b: forecast.budget_capacity(b.run_rate, monthly_budget=50_000.0, group_cols=ACCOUNT),
    # calculator analytics
    "data_maturity": lambda b: b.maturity,
    "executive_summary": lambda b: b.executive,
    "executive_summary_overall": lambda b: analytics.executive_summary(b.export),
    "top_cost_drivers": lambda b: analytics.top_cost_drivers(b.breakdown, group_cols=ACCOUNT),
    "service_breakdown": lambda b: b.breakdown,
    "service_breakdown_overall": lambda b: analytics.service_breakdown(b.export),
    "rolling_30d": lambda b: b.rolling,
    "rolling_30d_calendar": lambda b: analytics.rolling_30d(b.accounts, group_cols=ACCOUNT, calendar=True),
    "latest_rolling_30d": lambda b: b.latest,
    "latest_rolling_totals": lambda b: analytics.latest_rolling_totals(b.latest, group_cols=ACCOUNT),
    "history_header": lambda b: analytics.history_header(b.accounts, group_cols=ACCOUNT),
    "daily_trend": lambda b: analytics.daily_trend(b.export),
    "credit_summary": lambda b: analytics.credit_summary(b.accounts, group_cols=ACCOUNT),
    "user_totals": lambda b: attribution.user_totals(b.attribution),
    "top_users": lambda b: attribution.top_users(b.attribution),
    "user_hierarchy": lambda b: attribution.user_hierarchy(b.attribution),
    "user_hierarchy_levels": lambda b: attribution.user_hierarchy_levels(b.attribution),
    "user_drilldown": lambda b: attribution.user_drilldown(b.attribution),
    "function_overview": lambda b: analytics.function_overview(b.functions),
    "top_functions": lambda b: analytics.top_functions(b.functions),
    "top_function_models": lambda b: analytics.top_function_models(b.functions),
    "top_models": lambda b: analytics.top_models(b.models),
    "recent_trends": lambda b: analytics.recent_trends(b.trends, since=day_before(AS_OF, 30)),
    "function_model_matrix": lambda b: analytics.function_model_matrix(b.functions, models=MODELS),
    "function_daily": lambda b: analytics.function_daily(b.trends),
    "function_model_detail": lambda b: analytics.function_model_detail(b.functions),
    "rate_check": lambda b: analytics.rate_check(b.accounts, group_cols=ACCOUNT),
    "rate_card_join": _rate_card_join,
    "request_baseline": lambda b: b.baseline,
    "baseline_checks": lambda b: analytics.baseline_checks(b.baseline, group_cols=ACCOUNT),
    "persona_costs": lambda b: b.personas,
    "persona_totals": lambda b: analytics.persona_totals(b.personas, group_cols=ACCOUNT),
    "cost_per_user_calculator": lambda b: analytics.cost_per_user_calculator(b.accounts, group_cols=ACCOUNT),
    "summary_long": lambda b: analytics.summary_long(b.executive, group_cols=ACCOUNT),
    "summary_report": lambda b: analytics.summary_report(b.accounts, group_cols=ACCOUNT),
    "benchmark_band": lambda b: analytics.benchmark_band(b.accounts, group_cols=ACCOUNT),
    # SQL text
    "sql_over_views": _sql_over_views,
    # data quality
    "dq_missing_dates": lambda b: quality.missing_dates(b.account_days, as_of=AS_OF, group_cols=ACCOUNT),
    "dq_missing_dates_service": lambda b: quality.missing_dates(b.daily, as_of=AS_OF, group_cols=("service_type",)),
    "dq_stale_services": lambda b: quality.stale_services(b.account_days, as_of=AS_OF, days=2, group_cols=ACCOUNT),
    "dq_null_counts": lambda b: quality.null_counts(b.daily),
    "dq_ratio_accuracy": lambda b: quality.ratio_accuracy(b.daily),
    "dq_sum_consistency": lambda b: quality.sum_consistency(b.daily, b.export, as_of=AS_OF),
    "dq_value_ranges": lambda b: quality.value_ranges(b.daily),
    "dq_date_validity": lambda b: quality.date_validity(b.account_days, as_of=AS_OF, group_cols=ACCOUNT),
    "dq_unknown_services": lambda b: quality.unknown_services(b.uploaded, group_cols=ACCOUNT),
    "dq_duplicates": lambda b: quality.duplicates(b.uploaded.withColumnRenamed("date", "usage_date")),
    "dq_score": lambda b: quality.quality_score(
        rollups.with_ratios(b.uploaded.withColumnRenamed("date", "usage_date")), as_of=AS_OF, group_cols=ACCOUNT
    ),
    "dq_score_overall": lambda b: quality.quality_score(b.daily, as_of=AS_OF),
    "dq_recommendation": lambda b: quality.recommendation(
        rollups.with_ratios(b.uploaded.withColumnRenamed("date", "usage_date")), as_of=AS_OF, group_cols=ACCOUNT
    ),
    "dq_null_counts_faulty": lambda b: quality.null_counts(b.faulty_days, group_cols=ACCOUNT),
    "dq_ratio_accuracy_faulty": lambda b: quality.ratio_accuracy(b.faulty_days, group_cols=ACCOUNT),
    "dq_value_ranges_faulty": lambda b: quality.value_ranges(b.faulty_days, group_cols=ACCOUNT),
    "dq_date_validity_faulty": lambda b: quality.date_validity(b.faulty_days, as_of=AS_OF, group_cols=ACCOUNT),
    "dq_sum_consistency_faulty": lambda b: quality.sum_consistency(
        b.account_days, b.faulty_days.withColumnRenamed("usage_date", "date"), as_of=AS_OF
    ),
    "dq_score_faulty": lambda b: quality.quality_score(b.faulty_days, as_of=AS_OF, group_cols=ACCOUNT),
    "dq_recommendation_faulty": lambda b: quality.recommendation(b.faulty_days, as_of=AS_OF, group_cols=ACCOUNT),
    "check_results_faulty": lambda b: b.faulty_checks,
    "check_summary_faulty": lambda b: quality.check_summary(b.faulty_checks),
    "check_overall_faulty": lambda b: quality.check_overall(b.faulty_checks),
    "check_results": lambda b: b.checks,
    "check_results_views": lambda b: _checks_of_views(b, faulty=False),
    "check_results_views_faulty": lambda b: _checks_of_views(b, faulty=True),
    "check_results_stored": _check_results_stored,
    "check_summary": lambda b: quality.check_summary(b.checks),
    "check_overall": lambda b: quality.check_overall(b.checks),
    "export_stats": lambda b: quality.export_stats(b.export),
    "export_service_stats": lambda b: quality.export_service_stats(b.export),
    "export_recent": lambda b: quality.export_recent(b.export, as_of=AS_OF),
    "source_coverage": lambda b: quality.source_coverage(b.telemetry),
    # further reports
    "metering_reconcile": lambda b: extras.metering_reconcile(
        b.daily, rollups.metering_by_service(b.telemetry, **SCOPE), as_of=AS_OF
    ),
    "metering_totals": lambda b: extras.metering_totals(
        extras.metering_reconcile(b.daily, rollups.metering_by_service(b.telemetry, **SCOPE), as_of=AS_OF)
    ),
    "weekly_rollup": lambda b: extras.weekly_rollup(b.export),
    "service_activity": lambda b: extras.service_activity(b.daily),
    "failed_queries": lambda b: extras.failed_queries(b.telemetry.query_history, as_of=AS_OF, hours=24),
    "slow_queries": lambda b: extras.slow_queries(b.telemetry.query_history, pattern="%v_1-urgent%", as_of=AS_OF, hours=48),
    "function_cost_monthly": lambda b: extras.function_cost_monthly(b.telemetry, function_name="TRANSLATE", as_of=AS_OF),
    "function_cost_daily": lambda b: extras.function_cost_daily(b.telemetry, function_name="TRANSLATE", as_of=AS_OF),
    "cost_share_estimate": lambda b: extras.cost_share_estimate(b.export),
    "cost_sentence": lambda b: extras.cost_sentence(b.export, as_of=AS_OF),
    "text_chunks": lambda b: extras.text_chunks(b.documents, id_col="doc_id", text_col="text"),
    "non_ascii_docs": lambda b: extras.non_ascii_rows(b.documents, text_col="text"),
    "distinct_services": lambda b: extras.distinct_services(b.daily),
    # streaming
    "stream_daily_usage": _streamed,
    "stream_daily_usage_sketched": _stream_sketched,
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(QUERIES[name](Bed(spark, sf_dir)))
