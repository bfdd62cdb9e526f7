"""Usage files: the CSV exchange format of daily usage, its validation, and the choice between stored and live usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, StructField

from ..functions import services as S
from ..functions.columns import day_before
from .schemas import USAGE_CSV_REQUIRED, struct

USAGE_COLUMNS = ["date", "service_type", "daily_unique_users", "total_operations", "total_credits"]


class MissingColumns(ValueError):
    """The file lacks a required column."""


def read_usage_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily usage from CSV files (also .csv.gz) with a header in any letter case; further columns are kept as text.

    Values that do not parse become NULL, and ``bad_date`` / ``bad_credits`` tell such rows from empty ones. Only the
    header is looked at before the job runs.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    by_name = {c.strip().lower(): c for c in raw.columns}
    required = struct(USAGE_CSV_REQUIRED)
    missing = [f.name for f in required.fields if f.name.lower() not in by_name]
    if missing:
        raise MissingColumns(", ".join(missing))
    parsed = []
    for field in required.fields:
        source = F.col(f"`{by_name.pop(field.name.lower())}`")
        parsed.append(source.try_cast(field.dataType).alias(field.name.lower()))
        if field.name in ("DATE", "TOTAL_CREDITS"):
            short = "bad_date" if field.name == "DATE" else "bad_credits"
            parsed.append((source.isNotNull() & source.try_cast(field.dataType).isNull()).alias(short))
    return raw.select(*parsed, *[F.col(f"`{c}`").alias(name) for name, c in by_name.items()])


def validation_report(
    usage: DataFrame, *, known: Sequence[str] = tuple(S.ROLLUP_SERVICES), group_cols: Sequence[str] = (),
    max_rows: int | None = None, max_span_days: int | None = None,
) -> DataFrame:
    """One row per group (file, account) and rule: number of findings and what they mean for the group."""

    def has(name: str):
        return F.col(name) if name in usage.columns else F.lit(False)

    facts = usage.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(has("bad_date") | F.col("date").isNull()).alias("bad_dates"),
        F.count_if(has("bad_credits")).alias("bad_credits"),
        F.count_if(F.col("total_credits") < 0).alias("negative_credits"),
        F.count_if(F.col("total_credits").isNull()).alias("null_credits"),
        F.count_if(~F.col("service_type").isin(list(known))).alias("unknown_services"),
        F.datediff(F.max("date"), F.min("date")).alias("span"),
    )
    rules = [
        ("empty", F.when(F.col("rows") == 0, 1).otherwise(0), "REJECT"),
        ("too_many_rows", F.when(F.col("rows") > max_rows, F.col("rows")).otherwise(0), "WARN"),
        ("invalid_date", F.col("bad_dates"), "REJECT"),
        ("long_date_range", F.when(F.col("span") > max_span_days, F.col("span")).otherwise(0), "WARN"),
        ("non_numeric_credits", F.col("bad_credits"), "REJECT"),
        ("negative_credits", F.col("negative_credits"), "REJECT"),
        ("null_credits", F.col("null_credits"), "DROP_ROWS"),
        ("unknown_service", F.col("unknown_services"), "WARN"),
    ]
    table = F.array(*[
        F.struct(
            F.lit(rule).alias("rule"), findings.cast("long").alias("findings"),
            F.when(findings > 0, action).otherwise("OK").alias("outcome"),
        )
        for rule, findings, action in rules
    ])
    return facts.select(*group_cols, F.explode(table).alias("_r")).select(*group_cols, "_r.*")


def validate_usage(
    usage: DataFrame, *, group_cols: Sequence[str] = (), **rules
) -> tuple[DataFrame, DataFrame]:
    """(clean, report): rows of groups without a rejecting finding, less those without credits, and the report."""
    report = validation_report(usage, group_cols=group_cols, **rules)
    rejected = report.where(F.col("outcome") == "REJECT")
    rows = usage.where(F.col("total_credits").isNotNull()).drop("bad_date", "bad_credits")
    if group_cols:
        return rows.join(rejected.select(*group_cols).distinct(), list(group_cols), "left_anti"), report
    findings = rejected.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.where(findings == 0), report


def snapshot_or_live(history: DataFrame, live: DataFrame, *, group_cols: Sequence[str] = ("service_type",)) -> DataFrame:
    """Stored usage where a group has any, live usage elsewhere; live rows carry no trend columns.

    Both inputs are read once: a window over the days of a group tells whether it has stored rows.
    """
    fallback = live.select(*[c for c in live.columns if c in history.columns])
    both = history.withColumn("origin", F.lit("snapshot")).unionByName(
        fallback.withColumn("origin", F.lit("live")), allowMissingColumns=True
    )
    is_stored = F.col("origin") == "snapshot"
    any_stored = F.max(is_stored).over(Window.partitionBy(*(group_cols or [F.lit(1)])))
    return both.withColumn("_any_stored", any_stored).where(is_stored | ~F.col("_any_stored")).drop("_any_stored")


def export_realtime(export: DataFrame, *, as_of, days: int = 90) -> DataFrame:
    """Columns of the usage file, rounded."""
    return export.where(F.col("date") >= F.lit(day_before(as_of, days))).select(
        "date", "service_type", "daily_unique_users", "total_operations",
        F.round("total_credits", 8).alias("total_credits"),
        F.round("credits_per_user", 8).alias("credits_per_user"),
        F.round("credits_per_operation", 12).alias("credits_per_operation"),
    )


def export_snapshot(history: DataFrame, *, as_of, days: int = 90) -> DataFrame:
    return history.where(F.col("date") >= F.lit(day_before(as_of, days))).select(
        "date", "service_type", "daily_unique_users", "total_operations",
        F.round("total_credits", 8).alias("total_credits"),
        F.round("credits_per_user", 8).alias("credits_per_user"),
        F.round("credits_per_operation", 12).alias("credits_per_operation"),
        F.round("credits_7d_ago", 8).alias("credits_7d_ago"),
        "credits_wow_growth_pct",
    )


def export_function_detail(function_summary: DataFrame) -> DataFrame:
    return function_summary.select(
        "function_name", "model_name", "call_count",
        F.round("total_credits", 8).alias("total_credits"),
        "total_tokens",
        F.round("avg_credits_per_call", 8).alias("avg_credits_per_call"),
        F.round("avg_tokens_per_call", 2).alias("avg_tokens_per_call"),
        F.round("cost_per_million_tokens", 8).alias("cost_per_million_tokens"),
        "serverless_calls", "compute_calls", "first_usage", "last_usage",
    )


def _plain(field: StructField) -> Column:
    """Numbers as digits: neither doubles nor small decimals are written in scientific notation."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, DoubleType):
        c = c.cast("decimal(38,12)")
    return c.cast("string") if isinstance(field.dataType, (DoubleType, DecimalType)) else c


def write_csv(df: DataFrame, path: str, *, compression: str = "none", upper_names: bool = True) -> None:
    """Write as CSV with header, one file per task; names in upper case as the usage files have them."""
    out = df.select(*[_plain(f).alias(f.name.upper() if upper_names else f.name) for f in df.schema.fields])
    out.write.mode("errorifexists").option("header", True).option("compression", compression).csv(path)


def append_results(df: DataFrame, path: str, *, run: str) -> None:
    """Add the rows of a run (check results) to a parquet table, under the run's name: a run that is repeated, after a failure or
    by hand, replaces its rows."""
    (
        df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run").parquet(path)
    )
