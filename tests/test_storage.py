"""Upserts, the daily snapshot job, usage files, settings and the stream, on real files."""

import glob
import gzip
from datetime import date, datetime, timedelta

import pytest
from shared import SF, one, rows
from pyspark.sql import functions as F

from spendlens.functions import services as S
from spendlens.functions.columns import ts
from spendlens.operators import rollups, settings, snapshot
from spendlens.plans import testbed
from spendlens.session import scratch_path, shared_folder
from spendlens.sources import usage_files
from spendlens.sources.schemas import SCHEMAS, SNAPSHOT_SCHEMA, struct
from spendlens.sources.telemetry import Telemetry
from spendlens.sources.upsert import merge_into, upsert
from spendlens.streaming import daily_usage as stream

KEYED = "k STRING, sub STRING, v BIGINT, w BIGINT, at TIMESTAMP_NTZ"


def test_upsert_matches_null_with_empty(spark):
    target = spark.createDataFrame([("a", None, 1, 10, None), ("b", "x", 2, 20, None)], KEYED)
    source = spark.createDataFrame([("a", "", 5, 50), ("c", None, 6, 60)], "k STRING, sub STRING, v BIGINT, w BIGINT")
    merged = upsert(
        target, source, keys=["k", "sub"], update_cols=["v"], insert_cols=["k", "sub", "v", "w"], null_is_empty=["sub"],
        on_update={"at": ts(datetime(2025, 1, 1))}, on_insert={"at": ts(datetime(2025, 1, 2))},
    )
    got = {r["k"]: r for r in rows(merged)}
    assert (got["a"]["sub"], got["a"]["v"], got["a"]["w"], got["a"]["at"]) == (None, 5, 10, datetime(2025, 1, 1))
    assert (got["b"]["v"], got["b"]["at"]) == (2, None)
    assert (got["c"]["v"], got["c"]["w"], got["c"]["at"]) == (6, 60, datetime(2025, 1, 2))


def test_merge_into_touches_only_the_sources_partitions(spark):
    staged = f"{shared_folder(spark)}/merge-[sr]*"
    path, before = scratch_path(spark, "merged"), set(glob.glob(staged))
    schema = struct("day DATE, k STRING, v BIGINT")
    args = {"partition_col": "day", "schema": schema, "keys": ["day", "k"], "update_cols": ["v"], "insert_cols": ["day", "k", "v"]}

    def put(*records):
        merge_into(path, spark.createDataFrame(list(records), schema), **args)

    put((date(2025, 1, 1), "a", 1), (date(2025, 1, 2), "a", 2), (date(2025, 1, 3), "a", 3))
    untouched = spark.read.parquet(f"{path}/day=2025-01-02").inputFiles()
    put((date(2025, 1, 1), "a", 10), (date(2025, 1, 3), "b", 30))
    put((date(2025, 1, 1), "a", 10), (date(2025, 1, 3), "b", 30))
    got = sorted((r["day"].day, r["k"], r["v"]) for r in rows(spark.read.schema(schema).parquet(path)))
    assert got == [(1, "a", 10), (2, "a", 2), (3, "a", 3), (3, "b", 30)]
    assert spark.read.parquet(f"{path}/day=2025-01-02").inputFiles() == untouched
    merge_into(path, spark.createDataFrame([], schema), **args)
    with pytest.raises(ValueError, match="twice"):
        put((date(2025, 1, 1), "a", 1), (date(2025, 1, 1), "a", 2))
    assert spark.read.parquet(path).count() == 4
    assert set(glob.glob(staged)) == before


def test_daily_snapshot_job(spark):
    t = testbed.telemetry(spark, SF)
    path = scratch_path(spark, "snapshots")
    first, second = datetime(2024, 1, 30), datetime(2024, 1, 31)
    snapshot.run_daily_snapshot(t, path, as_of=first, run_ts=first)
    snapshot.run_daily_snapshot(t, path, as_of=second, run_ts=second)
    stored = spark.read.schema(struct(SNAPSHOT_SCHEMA)).parquet(path)
    before = sorted(map(str, rows(stored)))
    snapshot.run_daily_snapshot(t, path, as_of=second, run_ts=second)
    stored = spark.read.schema(struct(SNAPSHOT_SCHEMA)).parquet(path)
    assert sorted(map(str, rows(stored))) == before and len(before) > 0
    keys = stored.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in snapshot.KEYS]).count()
    assert keys.where("count > 1").count() == 0
    latest = snapshot.latest_snapshot(stored)
    totals = latest.where("usage_date = DATE'2024-01-29'").agg(F.sum("total_credits")).first()[0]
    live = rollups.daily_summary(t, as_of=second).where("usage_date = DATE'2024-01-29'").agg(F.sum("total_credits")).first()[0]
    assert totals == live


def test_backfill_equals_the_daily_jobs(spark):
    t = testbed.telemetry(spark, SF)
    columns = [c for c in snapshot.STORED]
    as_of = datetime(2024, 1, 31)
    backfilled = snapshot.backfill_snapshots(t, as_of=as_of)
    for back in (0, 3):
        day = as_of - timedelta(days=back)
        job = sorted(map(str, rows(snapshot.snapshot_source(t, as_of=day).select(columns))))
        same = sorted(map(str, rows(backfilled.where(F.col("snapshot_date") == F.lit(day.date())).select(columns))))
        assert job == same


def test_rollup_total_is_the_sum_of_its_sources(spark):
    t = testbed.telemetry(spark, SF)
    total = rollups.daily_summary(t, as_of=testbed.AS_OF).agg(F.sum("total_credits")).first()[0]
    parts = [("analyst", "credits"), ("search_daily", "credits"), ("functions", "token_credits"), ("documents", "credits_used"), ("fine_tuning", "token_credits")]
    assert total == sum(t.recent(name, testbed.AS_OF).agg(F.sum(c)).first()[0] for name, c in parts)


def test_telemetry_round_trip_through_files(spark):
    t = testbed.telemetry(spark, SF)
    root = scratch_path(spark, "telemetry")
    for name in SCHEMAS:
        getattr(t, name).select(*struct(SCHEMAS[name]).names).write.parquet(f"{root}/{name}")
    stored = Telemetry.read(spark, root)
    expected = sorted(map(str, rows(rollups.daily_summary(t, as_of=testbed.AS_OF))))
    assert sorted(map(str, rows(rollups.daily_summary(stored, as_of=testbed.AS_OF)))) == expected
    plan = stored.recent("functions", testbed.AS_OF, 30).select("tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(usage_time,2024-01-01" in plan and "ReadSchema: struct<usage_time:timestamp_ntz,tokens:bigint>" in plan


def csv_file(spark, text, name="usage.csv"):
    import os

    folder = scratch_path(spark, "csv")
    os.makedirs(folder)
    if name.endswith(".gz"):
        with gzip.open(f"{folder}/{name}", "wt") as f:
            f.write(text)
    else:
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    return folder


HEADER = "Date,service_type,DAILY_UNIQUE_USERS,TOTAL_OPERATIONS,TOTAL_CREDITS,NOTE\n"


@pytest.mark.parametrize("name", ["usage.csv", "usage.csv.gz"])
def test_read_usage_csv(spark, name):
    path = csv_file(spark, HEADER + "2025-01-05,Analyst,3,10,1.5,x\n2025-13-01,Search,1,1,abc,\n,Search,1,1,,\n", name)
    got = sorted(rows(usage_files.read_usage_csv(spark, path)), key=lambda r: (r["date"] is None, str(r["total_credits"])))
    assert got[0]["date"] == date(2025, 1, 5) and float(got[0]["total_credits"]) == 1.5 and got[0]["note"] == "x"
    assert sum(r["bad_date"] for r in got) == 1 and sum(r["bad_credits"] for r in got) == 1


def test_csv_without_a_required_column(spark):
    with pytest.raises(usage_files.MissingColumns, match="TOTAL_CREDITS"):
        usage_files.read_usage_csv(spark, csv_file(spark, "DATE,SERVICE_TYPE,DAILY_UNIQUE_USERS,TOTAL_OPERATIONS\n"))


def test_validation_rules(spark, usage):
    def outcome(df):
        return {r["rule"]: (r["findings"], r["outcome"]) for r in rows(usage_files.validation_report(df, max_rows=3, max_span_days=20))}

    fine = usage([(0, S.ANALYST, 1, 1, 1.0)])
    assert {o for _, o in outcome(fine).values()} == {"OK"}
    assert outcome(fine.where("false"))["empty"] == (1, "REJECT")
    bad = usage([(0, S.ANALYST, 1, 1, 100.0), (1, S.ANALYST, 1, 1, -50.0), (2, "Mystery", 1, 1, 200.0), (25, S.SEARCH, 1, 1, -10.0), (3, S.SEARCH, 1, 1, None), (4, S.SEARCH, 1, 1, None)])
    got = outcome(bad)
    assert got["negative_credits"] == (2, "REJECT") and got["null_credits"] == (2, "DROP_ROWS")
    assert got["unknown_service"] == (1, "WARN") and got["too_many_rows"] == (6, "WARN") and got["long_date_range"] == (25, "WARN")
    clean, _ = usage_files.validate_usage(bad)
    assert clean.count() == 0
    clean, _ = usage_files.validate_usage(bad.where("total_credits >= 0 OR total_credits IS NULL"))
    assert clean.count() == 2


def test_validation_rejects_per_group(usage):
    df = usage([(0, S.ANALYST, 1, 1, 1.0)]).withColumn("account", F.lit("good")).unionByName(
        usage([(0, S.ANALYST, 1, 1, -1.0), (1, S.ANALYST, 1, 1, 5.0)]).withColumn("account", F.lit("bad")))
    clean, report = usage_files.validate_usage(df, group_cols=("account",))
    assert [r["account"] for r in rows(clean)] == ["good"]
    assert report.where("account = 'bad' AND outcome = 'REJECT'").count() == 1


def test_csv_export_has_no_scientific_notation(spark, usage):
    path = scratch_path(spark, "export")
    export = rollups.cost_export(rollups.with_ratios(usage([(0, "A", 1, 4_000_000, 0.000012)]).withColumnRenamed("date", "usage_date")))
    usage_files.write_csv(usage_files.export_realtime(export, as_of=datetime(2025, 1, 31)).select("date", "total_credits", "credits_per_operation"), path)
    text = [r["value"] for r in rows(spark.read.text(path))]
    assert set(text) == {"DATE,TOTAL_CREDITS,CREDITS_PER_OPERATION", "2025-01-01,0.000012,0.000000000003"}


def test_check_results_are_appended(spark, usage):
    from spendlens.operators import quality

    path = scratch_path(spark, "checks")
    df = rollups.with_ratios(usage([(0, "A", 1, 1, 1.0)]).withColumnRenamed("date", "usage_date"))
    for day in (30, 31, 31):  # the last run is repeated
        usage_files.append_results(quality.check_results(df, as_of=datetime(2025, 1, day), run_ts=datetime(2025, 1, day)), path, run=f"2025-01-{day:02}")
    assert spark.read.parquet(path).count() == 10


def test_snapshot_wins_over_live(spark, usage):
    stored = usage([(0, "A", 1, 1, 1.0)]).withColumn("credits_7d_ago", F.lit(3.0))
    live = usage([(0, "A", 9, 9, 9.0), (0, "B", 2, 2, 2.0)])
    got = {r["service_type"]: r for r in rows(usage_files.snapshot_or_live(stored, live))}
    assert got["A"]["origin"] == "snapshot" and float(got["A"]["total_credits"]) == 1.0
    assert got["B"]["origin"] == "live" and got["B"]["credits_7d_ago"] is None
    assert {r["origin"] for r in rows(usage_files.snapshot_or_live(stored, live, group_cols=()))} == {"snapshot"}
    assert usage_files.snapshot_or_live(stored.where("false"), live, group_cols=()).count() == 2


def test_settings_keep_their_values(spark):
    owner = spark.range(1).select(F.lit("acme").alias("account"))
    defaults = settings.config_defaults(owner)
    assert defaults.count() == len(S.DEFAULT_SETTINGS)
    stored = defaults.where("setting_name = 'CREDIT_COST_USD'").withColumn("setting_value", F.lit("9.99")).withColumn(
        "description", F.lit("old")).withColumn("updated_at", ts(datetime(2024, 1, 1))).withColumn("updated_by", F.lit("me"))
    merged = settings.config_upsert(stored, defaults, run_ts=datetime(2025, 1, 1), run_by="job", group_cols=("account",))
    kept = one(merged.where("setting_name = 'CREDIT_COST_USD'"))
    assert kept["setting_value"] == "9.99" and kept["description"] == "Credit cost in USD" and kept["updated_by"] == "me"
    assert one(settings.config_value(merged, "LOOKBACK_DAYS"))["setting_value"] == "90"
    assert one(settings.config_summary(merged)) == {"settings_count": len(S.DEFAULT_SETTINGS), "last_updated": datetime(2025, 1, 1)}
    typed = merged.select("setting_name", settings.typed_value(F.col("data_type"), F.col("setting_value")).alias("v"))
    values = {r["setting_name"]: r["v"] for r in rows(typed)}
    assert values["LOOKBACK_DAYS"] == 90.0 and values["DEFAULT_CURRENCY"] is None


def test_stream_absorbs_late_events_and_repeats(spark):
    schema = "event_time TIMESTAMP, service_type STRING, user BIGINT, operations BIGINT, credits DECIMAL(18,6)"
    source, table, parts, checkpoint = (scratch_path(spark, n) for n in ("events", "daily", "parts", "stream-state"))

    def send(*events):
        data = [(datetime(2025, 1, d, h), s, u, 1, None) for d, h, s, u in events]
        spark.createDataFrame(data, schema).withColumn("credits", F.lit(0.5).cast("decimal(18,6)")).write.mode("append").parquet(source)
        events_in = spark.readStream.schema(schema).parquet(source)
        query = stream.start_daily_usage(events_in, path=table, parts=parts, checkpoint=checkpoint, availableNow=True)
        query.awaitTermination()
        return {(r["usage_date"].day, r["service_type"]): (r["events"], float(r["total_credits"]), r["users"])
                for r in rows(spark.read.schema(stream.DAILY_SCHEMA).parquet(table))}

    assert send((10, 1, "A", 1), (10, 2, "A", 2), (11, 1, "B", 1)) == {(10, "A"): (2, 1.0, 2), (11, "B"): (1, 0.5, 1)}
    after = send((10, 23, "A", 1), (12, 1, "A", 1))  # a late event for the 10th
    assert after == {(10, "A"): (3, 1.5, 2), (11, "B"): (1, 0.5, 1), (12, "A"): (1, 0.5, 1)}
    # days behind the newest one by more than any watermark
    send((20, 1, "A", 1))
    send((21, 1, "A", 3))
    after = send((10, 5, "A", 7), (20, 2, "A", 1))
    assert (after[(10, "A")], after[(20, "A")], after[(21, "A")]) == ((4, 2.0, 3), (2, 1.0, 1), (1, 0.5, 1))


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize("money", ["DOUBLE", "DECIMAL(18,9)", "DECIMAL(38,2)"])
def test_telemetry_is_read_in_its_stored_types(spark, money):
    root = scratch_path(spark, "telemetry")
    names = struct(SCHEMAS["analyst"]).names
    row = spark.sql(f"SELECT TIMESTAMP_NTZ'2025-01-02 00:00:00' AS start_time, TIMESTAMP_NTZ'2025-01-02 00:01:00' AS end_time, "
                    f"'u' AS username, CAST(0.25 AS {money}) AS credits, 3 AS request_count")
    row.write.parquet(f"{root}/analyst")
    got = Telemetry.read(spark, root).analyst
    assert got.schema.names == names and dict(got.dtypes)["credits"] == "decimal(26,12)"
    assert float(got.first()["credits"]) == pytest.approx(0.25, abs=0.06)


def test_credits_below_a_millionth_survive_a_file(spark):
    path = scratch_path(spark, "tiny")
    df = spark.sql("SELECT DATE'2025-01-01' AS date, 'A' AS service_type, 1L AS daily_unique_users, 1L AS total_operations, "
                   "CAST(0.00000012 AS DECIMAL(38,12)) AS total_credits")
    usage_files.write_csv(df, path)
    assert f"{one(usage_files.read_usage_csv(spark, path))['total_credits']:f}" == "0.000000120000"
