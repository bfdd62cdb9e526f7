"""The derived relations by name, for SQL text.

Every relation becomes a temporary view; those that build on others read these views, so the names have one order. Views are lazy:
a query over them is one plan, and its filters reach the scans of the usage tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .operators import active_users, analytics, anomalies, attribution, details, extras, forecast, rollups, seasonal, snapshot
from .sources.telemetry import Telemetry

Maker = Callable[[Callable[[str], DataFrame], Telemetry, dict], DataFrame]

#: name -> how it is made from earlier views, the telemetry and the scope (as_of, lookback_days)
VIEWS: dict[str, Maker] = {
    "analyst_detail": lambda get, t, s: details.analyst_detail(t, **s),
    "search_detail": lambda get, t, s: details.search_detail(t, **s),
    "search_serving_detail": lambda get, t, s: details.search_serving_detail(t, **s),
    "functions_detail": lambda get, t, s: details.functions_detail(t, **s),
    "functions_query_detail": lambda get, t, s: details.functions_query_detail(t, **s),
    "document_legacy_detail": lambda get, t, s: details.document_legacy_detail(t, **s),
    "document_detail": lambda get, t, s: details.document_detail(t, **s),
    "fine_tuning_detail": lambda get, t, s: details.fine_tuning_detail(t, **s),
    "function_summary": lambda get, t, s: rollups.function_summary(t, **s),
    "model_comparison": lambda get, t, s: rollups.model_comparison(t, **s),
    "function_daily_trends": lambda get, t, s: rollups.function_daily_trends(t, **s),
    "user_spend_attribution": lambda get, t, s: attribution.user_spend_attribution(t, **s),
    "user_spend_summary": lambda get, t, s: attribution.user_spend_summary(get("user_spend_attribution")),
    "user_feature_usage": lambda get, t, s: attribution.user_feature_usage(get("user_spend_attribution")),
    "active_users": lambda get, t, s: active_users.active_users_sliding(get("user_spend_attribution"), as_of=s["as_of"].date()),
    "daily_summary": lambda get, t, s: rollups.daily_summary(t, **s),
    "cost_export": lambda get, t, s: rollups.cost_export(get("daily_summary")),
    "metering_ai_services": lambda get, t, s: rollups.metering_by_service(t, **s),
    "weekly_rollup": lambda get, t, s: extras.weekly_rollup(get("cost_export")),
    "rolling_30d": lambda get, t, s: analytics.rolling_30d(get("cost_export")),
    "cost_anomalies": lambda get, t, s: anomalies.cost_anomalies(get("daily_summary"), **s),
    "cost_anomalies_current": lambda get, t, s: anomalies.cost_anomalies_current(get("cost_anomalies"), as_of=s["as_of"]),
    "cost_anomaly_summary": lambda get, t, s: anomalies.cost_anomaly_summary(get("cost_anomalies"), as_of=s["as_of"]),
    "snapshots": lambda get, t, s: snapshot.backfill_snapshots(t, **s),
    "usage_history": lambda get, t, s: snapshot.usage_history(get("snapshots")),
    "forecast_input": lambda get, t, s: forecast.forecast_input(snapshot.latest_snapshot(get("snapshots")), as_of=s["as_of"]),
    "usage_forecast": lambda get, t, s: forecast.forecast_12m(get("forecast_input")),
    "usage_forecast_seasonal": lambda get, t, s: seasonal.forecast_seasonal(get("forecast_input")),
}


def register_views(spark: SparkSession, t: Telemetry, *, as_of: datetime, lookback_days: int = 90, prefix: str = "v_") -> list[str]:
    """Registers all views of the session as of a time, in place of earlier ones with the same prefix; returns their names."""
    scope = {"as_of": as_of, "lookback_days": lookback_days}

    def get(name: str) -> DataFrame:
        return spark.table(prefix + name)

    for name, make in VIEWS.items():
        make(get, t, scope).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in VIEWS]
