"""Daily snapshots: what a day's job stores, how it is merged, and the history read back from it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import as_date, day_before, long_lit, mean, pct_change, per_million0, ratio0, round_cents, ts, windowed
from ..sources.schemas import SNAPSHOT_SCHEMA, names, struct
from ..sources.telemetry import Telemetry
from ..sources.upsert import merge_into, upsert
from ..sources.versions import publish_merge
from . import details, rollups

KEYS = ["snapshot_date", "service_type", "usage_date", "function_name", "model_name"]
NULLABLE_KEYS = ["function_name", "model_name"]
STORED = [c for c in names(SNAPSHOT_SCHEMA) if c != "inserted_at"]
MEASURES = [c for c in STORED if c not in KEYS]


def _stored_form(df: DataFrame) -> DataFrame:
    """All snapshot columns with their stored types; columns a service does not have are NULL."""
    types = {f.name: f.dataType for f in struct(SNAPSHOT_SCHEMA).fields}
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(None)).cast(types[c]).alias(c) for c in STORED if c != "snapshot_date"
    ])


#: days a query may run before its documents are processed
LONGEST_QUERY_DAYS = 7


def usage_by_feature(
    t: Telemetry, *, as_of: datetime, lookback_days: int = 90, repeat_functions: bool = False,
    longest_query_days: int = LONGEST_QUERY_DAYS, older_queries: bool = False,
) -> DataFrame:
    """Rows a snapshot holds for each usage day, without the snapshot date.

    The daily rollup supplies services without finer detail; functions and fine-tuning come per model and documents per
    function and model. The query history is read back to ``longest_query_days`` before the documents; a document whose
    query started earlier, or is unknown, counts without a user (unmatched_documents() counts these). With
    ``older_queries`` the queries that are missing there are looked up in all of the older history. ``repeat_functions`` also
    keeps the function rows of the rollup, which counts the same credits twice.
    """
    scope = {"as_of": as_of, "lookback_days": lookback_days}
    history = t.recent("query_history", as_of, lookback_days + longest_query_days).select("query_id", "user_name")
    detailed = [S.FUNCTION_MODELS, S.DOCUMENTS, S.FINE_TUNING] + ([] if repeat_functions else [S.FUNCTIONS])
    general = rollups.daily_summary(t, **scope).where(~F.col("service_type").isin(detailed))
    functions = rollups.function_daily_trends(t, **scope).select(
        F.lit(S.FUNCTION_MODELS).alias("service_type"), "usage_date", "function_name", "model_name",
        long_lit(0).alias("daily_unique_users"),
        F.col("hourly_records").alias("total_operations"),
        F.col("daily_credits").alias("total_credits"),
        F.lit(0.0).alias("credits_per_user"),
        ratio0("daily_credits", "hourly_records").alias("credits_per_operation"),
        F.col("daily_tokens").alias("total_tokens"),
        per_million0("daily_credits", "daily_tokens").alias("cost_per_million_tokens"),
        "serverless_calls", "compute_calls",
    )
    # usage shrinks to one row per query and feature before the large join; the averages are averages of per-record
    # ratios, so their sums and counts are carried through
    per_query = (
        details.document_detail(t, **scope)
        .groupBy("service_type", "usage_date", "function_name", "model_name", "query_id")
        .agg(
            F.sum("page_count").alias("pages"), F.sum("document_count").alias("documents"),
            F.sum("credits_used").alias("credits"), F.count(F.lit(1)).alias("records"),
            F.sum(F.col("credits_per_page").cast("decimal(28,9)")).alias("page_rates"),
            F.sum(F.col("credits_per_document").cast("decimal(28,9)")).alias("document_rates"),
        )
    )
    if older_queries:
        missing = per_query.select("query_id").distinct().join(history, "query_id", "left_anti")
        older = t.query_history.where(F.col("start_time") < ts(as_of - timedelta(days=lookback_days + longest_query_days)))
        history = history.unionByName(older.select("query_id", "user_name").join(missing, "query_id", "left_semi"))
    documents = (
        per_query.join(history, "query_id", "left")
        .groupBy("service_type", "usage_date", "function_name", "model_name")
        .agg(
            F.count_distinct("user_name").alias("daily_unique_users"),
            F.sum("pages").alias("total_operations"),
            F.sum("credits").alias("total_credits"),
            F.sum("documents").alias("total_documents_processed"),
            (F.sum("page_rates").cast("double") / F.sum("records")).alias("credits_per_page"),
            (F.sum("document_rates").cast("double") / F.sum("records")).alias("credits_per_document"),
        )
        .withColumns({
            "credits_per_user": F.lit(0.0),
            "credits_per_operation": F.col("credits_per_page"),
            "total_pages_processed": F.col("total_operations"),
        })
    )
    fine_tuning = (
        details.fine_tuning_detail(t, **scope)
        .groupBy("service_type", "usage_date", "model_name")
        .agg(
            F.count(F.lit(1)).alias("total_operations"),
            F.sum("token_credits").alias("total_credits"),
            mean("token_credits").alias("credits_per_operation"),
            F.sum("tokens").alias("total_tokens"),
            mean(F.col("cost_per_million_tokens").cast("decimal(28,6)")).alias("cost_per_million_tokens"),
        )
        .withColumns({"daily_unique_users": long_lit(0), "credits_per_user": F.lit(0.0)})
    )
    every = _stored_form(general)
    for part in (functions, documents, fine_tuning):
        every = every.unionByName(_stored_form(part))
    return every


def unmatched_documents(
    t: Telemetry, *, as_of: datetime, lookback_days: int = 90, longest_query_days: int = LONGEST_QUERY_DAYS
) -> DataFrame:
    """Documents per day, and how many of them find no query in the part of the history that the snapshot reads."""
    history = t.recent("query_history", as_of, lookback_days + longest_query_days).select("query_id", F.lit(1).alias("known")).distinct()
    return (
        t.recent("documents", as_of, lookback_days)
        .groupBy(F.col("start_time").cast("date").alias("usage_date"), "query_id").agg(F.count(F.lit(1)).alias("n"))
        .join(history, "query_id", "left").groupBy("usage_date")
        .agg(F.sum("n").alias("documents"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unmatched"))
    )


def snapshot_source(
    t: Telemetry, *, as_of: datetime, days: int = 2, lookback_days: int = 90, repeat_functions: bool = False
) -> DataFrame:
    """What the job of ``as_of`` stores: the trailing days, so late telemetry is absorbed by the next run."""
    rows = usage_by_feature(
        t, as_of=as_of, lookback_days=min(days + 1, lookback_days), repeat_functions=repeat_functions
    )
    return rows.where(
        F.col("usage_date").between(F.lit(day_before(as_of, days)), F.lit(as_date(as_of)))
    ).select(F.lit(as_date(as_of)).alias("snapshot_date"), "*").select(*STORED)


def snapshot_upsert(target: DataFrame, source: DataFrame, *, run_ts: datetime) -> DataFrame:
    """Target after merging one snapshot; NULL and '' are the same function or model name."""
    return upsert(
        target, source, keys=KEYS, update_cols=MEASURES, insert_cols=STORED, null_is_empty=NULLABLE_KEYS,
        on_update={"inserted_at": ts(run_ts)}, on_insert={"inserted_at": ts(run_ts)},
    )


def run_daily_snapshot(t: Telemetry, path: str, *, as_of: datetime, run_ts: datetime, publish: bool = False) -> None:
    """The daily job: merge the snapshot of ``as_of`` into the table at ``path``. Running it again changes nothing.

    With ``publish`` the table is one of ``sources.versions``: readers see all of a run or nothing.

    Rows match only within one snapshot date, so the table is partitioned by it: a job rewrites its own partition and
    never the stored history. A partition holds three usage days, which file statistics separate.
    """
    merge = publish_merge if publish else merge_into
    merge(
        path, snapshot_source(t, as_of=as_of), partition_col="snapshot_date", schema=struct(SNAPSHOT_SCHEMA),
        keys=KEYS, update_cols=MEASURES, insert_cols=STORED, null_is_empty=NULLABLE_KEYS,
        on_update={"inserted_at": ts(run_ts)}, on_insert={"inserted_at": ts(run_ts)},
    )


def backfill_snapshots(t: Telemetry, *, as_of: datetime, days: int = 2, lookback_days: int = 90) -> DataFrame:
    """The snapshot table as if the daily job had run for every day of the lookback: each usage day is stored on the
    day itself and the ``days`` days after it. One pass over the telemetry instead of one job per day."""
    rows = usage_by_feature(t, as_of=as_of, lookback_days=lookback_days)
    return (
        rows.withColumn("snapshot_date", F.explode(F.sequence("usage_date", F.date_add("usage_date", days))))
        .where(F.col("snapshot_date") <= F.lit(as_date(as_of)))
        .withColumn("inserted_at", F.col("snapshot_date").cast("timestamp_ntz") + F.expr("INTERVAL 3 HOURS"))
        .select(*names(SNAPSHOT_SCHEMA))
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """One row per usage day, service and feature: the one stored last."""
    keys = [c for c in KEYS if c != "snapshot_date"]
    rest = [c for c in snapshots.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("snapshot_date", "inserted_at"))
    grouped = snapshots.groupBy(*[
        F.coalesce(c, F.lit("")).alias(c) if c in NULLABLE_KEYS else F.col(c) for c in keys
    ]).agg(newest.alias("_row"))
    return grouped.select(
        *[F.nullif(F.col(c), F.lit("")).alias(c) if c in NULLABLE_KEYS else F.col(c) for c in keys], "_row.*"
    ).select(*snapshots.columns)


def usage_history(snapshots: DataFrame, *, calendar: bool = False) -> DataFrame:
    """Daily usage per service from the stored snapshots with week-over-week growth.

    Snapshots hold several rows per service and day (per model, and per snapshot date); the newest are summed to one
    row before the comparison. It looks 7 rows back, or 7 calendar days with ``calendar``.
    """
    daily = (
        latest_snapshot(snapshots)
        .groupBy("usage_date", "service_type")
        .agg(
            F.sum("daily_unique_users").alias("daily_unique_users"),
            F.sum("total_operations").alias("total_operations"),
            F.sum("total_credits").alias("total_credits"),
            F.max("snapshot_date").alias("snapshot_date"),
            F.max("inserted_at").alias("inserted_at"),
            F.sum("total_pages_processed").alias("total_pages_processed"),
            F.sum("total_documents_processed").alias("total_documents_processed"),
        )
    )
    by_day = windowed(["service_type"], F.col("usage_date"))
    if calendar:
        days = windowed(["service_type"], F.datediff("usage_date", F.lit("1970-01-01").cast("date")))
        before = F.max("total_credits").over(days.rangeBetween(-7, -7))
    else:
        before = F.lag("total_credits", 7).over(by_day)
    users = F.col("daily_unique_users")
    return (
        rollups.with_ratios(daily)
        .withColumn("credits_7d_ago", before)
        .select(
            F.col("usage_date").alias("date"), "service_type", "daily_unique_users",
            users.alias("weekly_active_users"), users.alias("monthly_active_users"), "total_operations",
            "total_credits", "credits_per_user", "credits_per_operation",
            round_cents("credits_per_user", 4).alias("avg_daily_cost_per_user"),
            round_cents(F.col("credits_per_user") * 30).alias("projected_monthly_cost_per_user"),
            round_cents(F.col("total_credits") * 30).alias("projected_monthly_total_credits"),
            "snapshot_date", "inserted_at", "total_pages_processed", "total_documents_processed",
            ratio0("total_credits", "total_pages_processed").alias("credits_per_page"),
            ratio0("total_credits", "total_documents_processed").alias("credits_per_document"),
            "credits_7d_ago",
            F.round(pct_change("total_credits", "credits_7d_ago"), 2).alias("credits_wow_growth_pct"),
        )
    )
