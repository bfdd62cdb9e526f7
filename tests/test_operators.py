"""Attribution, rollup, anomalies and quality on small tables with the awkward cases."""

from datetime import date, datetime

import pytest
from shared import AS_OF, one, rows
from pyspark.sql import functions as F

from spendlens.operators import anomalies, attribution, details, extras, quality, rollups
from spendlens.sources.schemas import SCHEMAS, struct
from spendlens.sources.telemetry import Telemetry

DAY = datetime(2025, 1, 20)


@pytest.fixture(scope="module")
def empty(spark):
    return Telemetry(**{name: spark.createDataFrame([], struct(ddl)) for name, ddl in SCHEMAS.items()})


@pytest.fixture
def table(spark):
    def build(name, *records):
        schema = struct(SCHEMAS[name])
        text = struct(", ".join(f"{f.name} {'DOUBLE' if 'decimal' in f.dataType.simpleString() else f.dataType.simpleString()}" for f in schema.fields))
        df = spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in records], text)
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    return build


def function_call(**values):
    return {"usage_time": DAY, "query_id": "q", "function_name": "COMPLETE", "model_name": "m", "warehouse_id": "0", "tokens": 10, "token_credits": 1.0, **values}


def test_empty_telemetry_gives_empty_views(empty):
    scope = {"as_of": AS_OF}
    for view in (rollups.daily_summary, attribution.user_spend_attribution, rollups.function_summary, rollups.model_comparison,
                 rollups.query_cost_analysis, rollups.top_queries, rollups.metering_by_service, details.search_detail):
        assert rows(view(empty, **scope)) == [], view.__name__


def test_unknown_and_missing_users_stay_in_function_spend(empty, table):
    t = empty.replace(functions=table("functions", function_call(user_id=1), function_call(user_id=2, token_credits=2.0), function_call(user_id=None, token_credits=4.0)),
        users=table("users", {"user_id": 1, "name": "ann"}),
    )
    got = {r["user_name"]: float(r["credits_used"]) for r in rows(attribution.user_spend_attribution(t, as_of=AS_OF))}
    assert got == {"ann": 1.0, None: 6.0}
    summary = one(rollups.daily_summary(t, as_of=AS_OF))
    assert summary["daily_unique_users"] == 1 and float(summary["total_credits"]) == 7.0 and summary["credits_per_user"] == 7.0


def test_two_ids_with_one_name_are_one_user(empty, table):
    t = empty.replace(functions=table("functions", function_call(user_id=1), function_call(user_id=2)),
        users=table("users", {"user_id": 1, "name": "ann"}, {"user_id": 2, "name": "ann"}),
    )
    assert one(rollups.daily_summary(t, as_of=AS_OF))["daily_unique_users"] == 1
    assert float(one(attribution.user_spend_attribution(t, as_of=AS_OF))["credits_used"]) == 2.0


def test_documents_are_attributed_on_the_day_of_their_query(empty, table):
    document = {"query_id": "q1", "start_time": DAY, "function_name": "PARSE", "model_name": None, "page_count": 0, "document_count": 1, "credits_used": 3.0}
    t = empty.replace(documents=table("documents", document, {**document, "query_id": "unseen"}),
        query_history=table("query_history", {"query_id": "q1", "user_name": "bob", "start_time": datetime(2025, 1, 19, 23)}),
    )
    spend = one(attribution.user_spend_attribution(t, as_of=AS_OF))
    assert spend["usage_date"] == date(2025, 1, 19) and spend["user_name"] == "bob" and spend["credits_per_operation"] is None
    summary = one(rollups.daily_summary(t, as_of=AS_OF))
    assert summary["usage_date"] == date(2025, 1, 20) and summary["daily_unique_users"] == 0
    assert float(summary["total_credits"]) == 6.0 and summary["credits_per_operation"] == 0.0


def test_search_counts_only_embedding_tokens(empty, table):
    search = {"usage_date": DAY.date(), "service_name": "s", "credits": 1.0, "consumption_type": "EMBED_TEXT_TOKENS"}
    t = empty.replace(search_daily=table(
        "search_daily", {**search, "tokens": "100"}, {**search, "tokens": "n/a"}, {**search, "tokens": "50", "consumption_type": "SERVING"}))
    got = one(rollups.daily_summary(t, as_of=AS_OF))
    assert (got["total_operations"], float(got["total_credits"]), got["daily_unique_users"]) == (100, 3.0, 0)


def test_numbers_in_text_keep_38_digits(empty, table):
    """A warehouse beyond BIGINT is a warehouse; a day whose tokens BIGINT can't hold has no number of operations, not 0."""
    many = "98765432109876543210"
    search = {"usage_date": DAY.date(), "service_name": "s", "credits": 1.0, "consumption_type": "EMBED_TEXT_TOKENS"}
    t = empty.replace(search_daily=table("search_daily", {**search, "tokens": many}),
                      functions=table("functions", function_call(warehouse_id=many), function_call(warehouse_id="-" + many)))
    assert int(one(details.search_detail(t, as_of=AS_OF))["tokens"]) == int(many)
    assert {int(r["warehouse_id"]) for r in rows(details.functions_detail(t, as_of=AS_OF))} == {int(many), -int(many)}
    got = one(rollups.function_summary(t, as_of=AS_OF))
    assert (got["serverless_calls"], got["compute_calls"]) == (0, 1)
    daily = {r["service_type"]: r for r in rows(rollups.daily_summary(t, as_of=AS_OF))}
    assert daily["Search"]["total_operations"] is None and float(daily["Search"]["total_credits"]) == 1.0


def test_lookback_is_inclusive(empty, table):
    t = empty.replace(functions=table("functions", function_call(usage_time=datetime(2024, 11, 2)), function_call(usage_time=datetime(2024, 11, 1, 23, 59))))
    assert details.functions_detail(t, as_of=AS_OF).count() == 1
    assert details.functions_detail(t, as_of=AS_OF, lookback_days=365).count() == 2


def test_function_summary_counts_calls_and_warehouses(empty, table):
    t = empty.replace(functions=table(
        "functions", function_call(query_id="a", warehouse_id="0"), function_call(query_id="a", warehouse_id="n/a"),
        function_call(query_id="b", warehouse_id="12", tokens=0), function_call(query_id=None, warehouse_id=None, usage_time=datetime(2025, 1, 22))))
    got = one(rollups.function_summary(t, as_of=AS_OF))
    assert (got["call_count"], got["serverless_calls"], got["compute_calls"], got["days_in_use"]) == (2, 3, 1, 3)
    assert got["cost_per_million_tokens"] == pytest.approx(4 / 30 * 1e6)


def test_query_ranks_and_top_k_agree(empty, table):
    calls = [function_call(query_id=f"q{i % 40}", token_credits=float(i % 7), tokens=i % 5) for i in range(300)]
    t = empty.replace(functions=table("functions", *calls))
    every = rows(rollups.query_cost_analysis(t, as_of=AS_OF))
    top = rows(rollups.top_queries(t, as_of=AS_OF, k=25))
    assert len(every) == sum(c["token_credits"] > 0 for c in calls)
    key = lambda r: tuple(sorted((k, str(v)) for k, v in r.items()))
    assert sorted(map(key, top)) == sorted(key(r) for r in every if r["cost_rank"] <= 25)


def daily(spark, values, service="A"):
    data = [(date(2025, 1, 1 + i), service, 1, 1, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "usage_date DATE, service_type STRING, daily_unique_users BIGINT, total_operations BIGINT, total_credits DOUBLE")
    return rollups.with_ratios(df.withColumn("total_credits", F.col("total_credits").cast("decimal(38,6)")))


@pytest.mark.parametrize("now, before, level, message", [
    (150, 100, "MEDIUM", "MEDIUM ALERT: A credits increased 50% vs last week"),
    (160, 100, "HIGH", "HIGH ALERT: A credits increased 60% vs last week"),
    (130, 100, "MEDIUM", "MEDIUM ALERT: A credits increased 30% vs last week"),
    (110, 100, "NORMAL", "NORMAL: No significant change detected"),
    (80, 100, "DECLINING", "NORMAL: No significant change detected"),
    (60, 100, "DECLINING", "DECLINING: A credits decreased 40% vs last week"),
    (50, 0, "NORMAL", "NORMAL: No significant change detected"),
])
def test_alert_levels(spark, now, before, level, message):
    got = one(anomalies.cost_anomalies(daily(spark, [before, 1, 1, 1, 1, 1, 1, now]), as_of=AS_OF))
    assert (got["alert_level"], got["alert_message"]) == (level, message)
    if before == 0:
        assert got["wow_growth_pct"] is None and float(got["wow_credits_change"]) == 50.0


def test_moving_average_and_thresholds(spark):
    values = [100, 2, 3, 4, 5, 6, 7, 120, 9]
    got = sorted(rows(anomalies.cost_anomalies(daily(spark, values), as_of=AS_OF, high=0.1, medium=0.05)), key=lambda r: r["date"])
    assert got[0]["credits_7d_avg"] == pytest.approx(sum(values[1:8]) / 7) and got[0]["alert_level"] == "HIGH"
    assert len(got) == 2


def test_calendar_comparison_ignores_rows_across_gaps(spark):
    data = daily(spark, [10] * 8).where(F.col("usage_date") != date(2025, 1, 4))
    assert rows(anomalies.cost_anomalies(data, as_of=AS_OF)) == []
    assert one(anomalies.cost_anomalies(data, as_of=AS_OF, calendar=True))["date"] == date(2025, 1, 8)


def test_alert_reports(spark):
    values = [10] * 7 + [20] * 7
    found = anomalies.cost_anomalies(daily(spark, values), as_of=datetime(2025, 1, 14))
    current = anomalies.cost_anomalies_current(found, as_of=datetime(2025, 1, 14))
    assert one(anomalies.anomaly_status(current))["current_status"] == "7 active anomalies detected"
    assert one(anomalies.anomaly_status(current.where("false")))["current_status"] == "No active anomalies detected"
    assert [r["date"].day for r in rows(anomalies.anomaly_top(current, k=2))] == [14, 13]
    summary = one(anomalies.cost_anomaly_summary(found, as_of=datetime(2025, 1, 14)))
    assert (summary["alert_count"], summary["affected_services"], summary["services_list"], summary["avg_growth_pct"]) == (7, 1, "A", 100.0)
    assert one(anomalies.anomaly_digest(current))["alert_digest"].count("; ") == 6


def test_quality_of_a_good_rollup(spark):
    good = daily(spark, [10] * 31)
    assert one(quality.missing_dates(good, as_of=AS_OF)) == {"missing_count": 0, "missing_dates": ""}
    score = one(quality.quality_score(good, as_of=AS_OF))
    assert score["overall_quality_score"] == 100.0 and score["quality_rating"] == "EXCELLENT"
    assert one(quality.recommendation(good, as_of=AS_OF))["recommendation"] == "No critical issues detected"
    results = quality.check_results(good, as_of=AS_OF, run_ts=AS_OF)
    assert {r["test_status"] for r in rows(results)} == {"PASS"} and len(rows(results)) == 5
    assert one(quality.check_overall(results))["overall_status"].startswith("ALL TESTS PASSED")


def test_quality_of_a_bad_rollup(spark):
    bad = daily(spark, [10, -5, 20]).withColumn("credits_per_user", F.col("credits_per_user") + F.when(F.col("total_credits") == 20, 1.0).otherwise(0.0))
    bad = bad.unionByName(bad.where("total_credits = 10")).unionByName(bad.limit(1).withColumn("service_type", F.lit(None).cast("string")))
    assert one(quality.null_counts(bad))["null_service_type"] == 1
    assert one(quality.ratio_accuracy(bad)) == {"error_count": 1, "total_credits_affected": 20.0}
    assert one(quality.value_ranges(bad))["negative_credits"] == 1
    assert one(quality.duplicates(bad))["duplicate_count"] == 2
    assert one(quality.missing_dates(bad, as_of=AS_OF))["missing_count"] == 28
    score = one(quality.quality_score(bad, as_of=AS_OF))
    assert (score["completeness_score"], score["accuracy_score"], score["validity_score"], score["consistency_score"]) == (10.0, 90, 95, 50)
    assert one(quality.recommendation(bad, as_of=AS_OF))["recommendation"].startswith("Investigate missing dates")
    results = quality.check_results(bad, as_of=AS_OF, run_ts=AS_OF)
    assert {r["test_number"]: r["test_status"] for r in rows(results)} == {7: "FAIL", 8: "FAIL", 9: "PASS", 10: "FAIL", 11: "FAIL"}
    assert one(quality.check_overall(results))["overall_status"].startswith("4 TEST(S) FAILED")


def test_quality_of_nothing(spark):
    nothing = daily(spark, [1]).where("false")
    assert one(quality.missing_dates(nothing, as_of=AS_OF))["missing_count"] == 31
    assert one(quality.quality_score(nothing, as_of=AS_OF))["completeness_score"] == 0.0
    assert {r["test_number"]: r["test_status"] for r in rows(quality.check_results(nothing, as_of=AS_OF, run_ts=AS_OF))}[9] == "WARN"
    assert rows(quality.stale_services(nothing, as_of=AS_OF)) == []


def test_stale_future_and_unknown(spark):
    df = daily(spark, [1] * 20).unionByName(daily(spark, [1] * 30, "Mystery"))
    assert one(quality.stale_services(df, as_of=AS_OF))["service_type"] == "A"
    assert one(quality.date_validity(df, as_of=datetime(2025, 1, 29)))["future_dates"] == 1
    assert {r["service_type"]: r["occurrence_count"] for r in rows(quality.unknown_services(df))} == {"A": 20, "Mystery": 30}


def test_chunks_cover_the_whole_text(spark):
    texts = ["", "a", "é" * 4000, "xy" * 2000 + "z", "".join(chr(97 + i % 26) for i in range(100_001))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {}
    for r in sorted(rows(extras.text_chunks(df, id_col="doc_id", text_col="text")), key=lambda r: (r["doc_id"], r["chunk_num"])):
        got.setdefault(r["doc_id"], []).append(r["text_chunk"])
    assert {i: "".join(parts) for i, parts in got.items()} == {i: t for i, t in enumerate(texts) if t}
    assert [len(got[i]) for i in (1, 2, 3, 4)] == [1, 1, 2, 26]


def test_non_ascii_filter(spark):
    df = spark.createDataFrame([("plain \x7f text",), ("naïve",), ("",), ("日本",)], "t STRING")
    assert [r["t"] for r in rows(extras.non_ascii_rows(df, text_col="t"))] == ["naïve", "日本"]


def test_reconciliation_keeps_days_of_either_side(spark):
    metered = spark.createDataFrame([(date(2025, 1, 2), 5.0), (date(2025, 1, 30), 7.0)], "usage_date DATE, total_credits DOUBLE")
    metered = metered.withColumn("total_credits", F.col("total_credits").cast("decimal(38,6)"))
    both = extras.metering_reconcile(daily(spark, [1, 2]), metered, as_of=AS_OF)
    got = {r["usage_date"].day: r["difference"] for r in rows(both)}
    assert got == {1: 1.0, 2: -3.0, 30: -7.0}
    assert {r["source"]: r["credits"] for r in rows(extras.metering_totals(both))} == {"Monitoring": 3.0, "Metering": 12.0}


def test_queries_older_than_the_window_are_looked_up(spark):
    from datetime import timedelta

    from spendlens.operators import snapshot
    from spendlens.sources.schemas import SCHEMAS, struct
    from spendlens.sources.telemetry import Telemetry

    def table(name, *given):
        schema = struct(SCHEMAS[name])
        return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in given], schema)

    day = AS_OF - timedelta(days=1)
    queries = [{"query_id": "new", "user_name": "ann", "start_time": day}, {"query_id": "old", "user_name": "bob", "start_time": day - timedelta(days=400)},
               {"query_id": "other", "user_name": "cy", "start_time": day - timedelta(days=400)}]
    documents = [{"query_id": q, "start_time": day, "function_name": "F", "page_count": 1, "document_count": 1} for q in ("new", "old", "none")]
    t = Telemetry(**{n: table(n) for n in SCHEMAS}).replace(documents=table("documents", *documents), query_history=table("query_history", *queries))
    users = {older: one(snapshot.usage_by_feature(t, as_of=AS_OF, older_queries=older).where("service_type = 'Document Processing'"))["daily_unique_users"]
             for older in (False, True)}
    assert users == {False: 1, True: 2}
