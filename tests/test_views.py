"""Derived relations and settings in SQL text, quantiles from summaries."""

from datetime import date, datetime, timedelta

import pytest
from shared import SF, rows
from pyspark.sql import functions as F

from spendlens import views
from spendlens.operators import quantiles, settings
from spendlens.plans import queries
from spendlens.session import scratch_path
from spendlens.sources.schemas import SCHEMAS, struct
from spendlens.sources.telemetry import Telemetry


def plan(df):
    return df._jdf.queryExecution().simpleString()


@pytest.fixture(scope="module")
def stored(spark):
    """Views over telemetry that is stored as files."""
    root = scratch_path(spark, "stored-telemetry")
    for name, ddl in SCHEMAS.items():
        spark.createDataFrame([], struct(ddl)).write.parquet(f"{root}/{name}")
    return views.register_views(spark, Telemetry.read(spark, root), as_of=datetime(2024, 1, 31), prefix="t_")


def test_every_view_is_there_and_empty_telemetry_gives_empty_views(spark, stored):
    assert stored == [f"t_{n}" for n in views.VIEWS]
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("t_")} == set(stored)
    for name in ("t_cost_export", "t_cost_anomalies_current", "t_usage_history", "t_active_users", "t_user_spend_summary"):
        assert spark.sql(f"SELECT * FROM {name}").count() == 0


def test_filters_of_sql_text_reach_the_scans_through_three_layers(spark, stored):
    text = plan(spark.sql("SELECT date, total_credits FROM t_cost_export WHERE service_type = 'Fine-tuning'"))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "GreaterThanOrEqual(start_time,2023-11-02T00:00" in scans[0]
    assert "model_name" not in scans[0]
    text = plan(spark.sql("SELECT * FROM t_cost_anomalies_current WHERE service_type = 'Analyst'"))
    assert text.count("FileScan") == 1


def test_views_follow_the_newest_registration(spark):
    bed = queries.Bed(spark, SF)
    for day in (20, 31):
        views.register_views(spark, bed.telemetry, as_of=datetime(2024, 1, day), lookback_days=5, prefix="n_")
        assert spark.sql("SELECT MIN(date) FROM n_cost_export").first()[0] == date(2024, 1, day) - timedelta(days=5)


def test_checks_of_views_make_joined_usage_once(spark):
    assert len(rows(queries.QUERIES["check_results_views"](queries.Bed(spark, SF)))) == 11
    for view in ("daily_summary", "user_spend_attribution", "usage_history", "usage_forecast"):
        text = plan(spark.table(f"checked_{view}"))
        assert "FileScan" in text and "l_orderkey" not in text and "p_partkey" not in text, view


def test_checks_go_on_where_joined_usage_fails(spark):
    bed = queries.Bed(spark, SF)
    broken = bed.telemetry.functions.withColumn("token_credits", F.raise_error(F.lit("broken")).cast("decimal(18,6)"))
    bed.telemetry = bed.telemetry.replace(functions=broken)
    got = {r["test_number"]: r["test_status"] for r in rows(queries.QUERIES["check_results_views"](bed))}
    assert got == {1: "PASS", 2: "PASS", 3: "PASS", 4: "PASS", 5: "PASS", 6: "PASS", 7: "FAIL"}


def test_stored_telemetry_has_the_same_rows_and_types(spark):
    calls = spark.sql("""
        SELECT * FROM VALUES (TIMESTAMP_NTZ'2025-01-01 01:00:00', 'q', 1L, 1.5BD), (NULL, NULL, NULL, NULL), (TIMESTAMP_NTZ'2025-01-01 01:00:00', 'q', 1L, 1.5BD)
        AS t(usage_time, query_id, tokens, token_credits)""")
    t = Telemetry(functions=lambda: calls, users=spark.createDataFrame([], struct(SCHEMAS["users"])), metering=calls)
    stored = t.stored(scratch_path(spark, "stored"), "functions", "users")
    assert stored.functions.dtypes == calls.dtypes and stored.functions.exceptAll(calls).count() == calls.exceptAll(stored.functions).count() == 0
    assert stored.users.dtypes == t.users.dtypes and stored.users.count() == 0
    assert "FileScan" in plan(stored.functions) and stored.metering is calls and t.functions is calls


def test_settings_function_prefers_what_is_stored(spark):
    stored = spark.createDataFrame(
        [("a", "CREDIT_COST_USD", "2.5"), ("a", "TEAM", "it's \\ours"), ("b", "ANOMALY_THRESHOLD_HIGH", "much")],
        "account STRING, setting_name STRING, setting_value STRING")
    settings.register_get_config(spark, stored)
    accounts = spark.createDataFrame([("a",), ("b",), (None,)], "account STRING")
    accounts.createOrReplaceTempView("asked")
    got = rows(spark.sql("""SELECT account, get_config(account, 'CREDIT_COST_USD') AS price, get_config(account, 'TEAM') AS team,
                                   get_config(account, 'no such') AS none FROM asked ORDER BY account NULLS LAST"""))
    default = next(v for n, v, *_ in settings.S.DEFAULT_SETTINGS if n == "CREDIT_COST_USD")
    assert [(r["price"], r["team"], r["none"]) for r in got] == [("2.5", "it's \\ours", None), (default, None, None), (default, None, None)]
    high = accounts.select("account", settings.configured_number("ANOMALY_THRESHOLD_HIGH").alias("high"))
    assert [r["high"] for r in rows(high)] == [0.5, 0.5, 0.5]
    text = plan(spark.sql("SELECT get_config(account, 'TEAM') FROM asked"))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_summaries_merge_to_the_quantiles_of_the_records(spark):
    start = datetime(2025, 1, 1)
    calls = spark.range(60_000).select(
        (F.lit(start) + F.make_dt_interval(days=(F.col("id") % 10).cast("int"))).cast("timestamp_ntz").alias("usage_time"),
        F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("model_name"),
        F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("decimal(26,12)").alias("token_credits"),
    )
    t = Telemetry(functions=calls)
    summaries = quantiles.credit_summaries(t, as_of=start + timedelta(days=10))
    path = scratch_path(spark, "summaries")
    summaries.write.parquet(path)
    kept = spark.read.parquet(path)
    assert kept.count() == 10 and max(len(r["summary"]) for r in rows(kept)) < 20_000
    days = {"first": date(2025, 1, 3), "last": date(2025, 1, 8)}
    answers = quantiles.credit_quantiles(kept, **days)
    got = rows(quantiles.rank_errors(answers, t, **days))
    assert len(got) == 2 and all(r["records"] == r["exact_records"] == 18_000 for r in got)
    assert all(r[f"{n}_rank_error"] <= 3 * quantiles.RANK_ERROR for r in got for n in quantiles.QUANTILES)
    # the check does see an answer that is off
    wrong = answers.withColumn("median_credits", F.col("median_credits") * 1.2)
    assert all(r["median_credits_rank_error"] > 0.05 for r in rows(quantiles.rank_errors(wrong, t, **days)))
