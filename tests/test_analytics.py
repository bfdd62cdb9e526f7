import random
from datetime import date

import pytest
from shared import one, rows
from pyspark.sql import functions as F

from spendlens.operators import analytics


@pytest.mark.parametrize("days, level, label, ready", [
    (1, "insufficient", "Insufficient", False), (3, "developing", "Developing", True), (7, "developing", "Improving", True),
    (14, "reliable", "Reliable", True), (30, "confident", "High Confidence", True),
])
def test_maturity_levels(usage, days, level, label, ready):
    got = one(analytics.data_maturity(usage([(i, "A", 1, 1, 1.0) for i in range(days)])))
    assert (got["level"], got["confidence_label"], got["ready_for_projection"]) == (level, label, ready)
    assert got["confidence_score"] == int(min(days / 30, 1.0) * 60 + 40)


def test_maturity_with_gaps_and_without_data(usage):
    got = one(analytics.data_maturity(usage([(0, "A", 1, 1, 1.0), (9, "A", 1, 1, 1.0)])))
    assert got["completeness"] == 0.2 and got["confidence_score"] == int(2 / 30 * 60 + 0.2 * 40)
    empty = one(analytics.data_maturity(usage([])))
    assert (empty["days"], empty["level"], empty["confidence_score"], empty["ready_for_projection"]) == (0, "none", 0, False)


def test_grouped_sums_of_services(usage):
    df = usage([(0, "A", 1, 10, 100.0), (1, "A", 3, 10, 150.0), (0, "B", 2, 0, 200.0), (1, "B", 2, 0, 250.0)])
    got = {r["service_type"]: r for r in rows(analytics.service_breakdown(df))}
    assert float(got["A"]["total_credits"]) == 250.0 and float(got["B"]["total_credits"]) == 450.0
    assert got["A"]["avg_daily_users"] == 2.0
    assert got["A"]["pct_of_total"] + got["B"]["pct_of_total"] == pytest.approx(100.0)
    assert got["A"]["monthly_cost_usd"] == 250.0 / 2 * 30 * 3
    drivers = rows(analytics.top_cost_drivers(analytics.service_breakdown(df), k=1))
    assert [d["service_type"] for d in drivers] == ["B"]


def test_shares_of_a_free_group_are_zero(usage):
    got = rows(analytics.service_breakdown(usage([(0, "A", 0, 0, 0.0), (0, "B", 0, 0, 0.0)])))
    assert [r["pct_of_total"] for r in got] == [0.0, 0.0]


def test_rolling_window_against_python(usage):
    rng = random.Random(42)
    credits = [round(rng.uniform(10, 50), 4) for _ in range(31)]
    df = usage([(i, "A", i % 3, 1, v) for i, v in enumerate(credits)])
    got = sorted(rows(analytics.rolling_30d(df, rows=7)), key=lambda r: r["date"])
    for i, r in enumerate(got):
        part = credits[max(0, i - 6): i + 1]
        assert r["credits_30d_total"] == pytest.approx(sum(part))
        assert r["operations_30d_total"] == len(part)
    assert got[0]["credits_30d_total"] == credits[0] and got[0]["cost_per_user_30d"] == 0.0


def test_rolling_series_of_five(usage):
    y = [10, 12, 15, 18, 20, 22, 25, 28, 30, 32]
    got = sorted(rows(analytics.rolling_30d(usage([(i, "Service A", 1, 1, float(v)) for i, v in enumerate(y)]), rows=5)), key=lambda r: r["date"])
    assert [r["credits_30d_total"] for r in got] == [sum(y[max(0, i - 4): i + 1]) for i in range(10)]


def test_calendar_window_sees_gaps(usage):
    df = usage([(0, "A", 1, 1, 1.0), (1, "A", 1, 1, 2.0), (20, "A", 1, 1, 4.0)])
    by_rows = {r["date"].day: r["credits_30d_total"] for r in rows(analytics.rolling_30d(df, rows=7))}
    by_days = {r["date"].day: r["credits_30d_total"] for r in rows(analytics.rolling_30d(df, rows=7, calendar=True))}
    assert by_rows[21] == 7.0 and by_days[21] == 4.0


def test_latest_rolling_takes_the_newest_row(usage):
    df = usage([(i, "A", 1, 1, float(i)) for i in range(10)])
    latest = analytics.latest_rolling_30d(analytics.rolling_30d(df))
    assert one(latest)["date"] == date(2025, 1, 10)
    assert one(analytics.latest_rolling_totals(latest))["total_30d_credits"] == 45.0


def test_two_sided_date_filter(usage):
    df = usage([(i, "Service A", 1, 1, 1.0) for i in range(10)])
    assert df.where(F.col("date").between(F.lit(date(2025, 1, 5)), F.lit(date(2025, 1, 8)))).count() == 4


def test_executive_summary_and_long_form(usage):
    summary = analytics.executive_summary(usage([(i, "A", 5, 10, 10.0) for i in range(30)]), price=2.0)
    got = one(summary)
    assert got["monthly_cost"] == 600.0 and got["annual_cost"] == 7200.0 and got["cost_per_user_month"] == 120.0
    assert got["lower_bound"] == pytest.approx(7200 * 0.95)
    metrics = {r["metric"]: r["value"] for r in rows(analytics.summary_long(summary))}
    assert len(metrics) == 8 and metrics["Analysis Period (days)"] == 30.0


def test_summaries_of_no_rows(usage):
    got = one(analytics.executive_summary(usage([])))
    assert got["days"] == 0 and got["avg_daily_credits"] == 0.0 and got["cost_per_user_month"] == 0.0
    assert rows(analytics.service_breakdown(usage([]))) == []
    assert rows(analytics.credit_summary(usage([]))) == []


def test_rate_check_statuses(usage):
    df = usage([(0, "Analyst", 1, 100, 6.7), (0, "Document Processing", 1, 1000, 50.0), (0, "Functions", 1, 10, 1.0), (0, "Search", 1, 0, 1.0)])
    got = {r["service_type"]: r for r in rows(analytics.rate_check(df))}
    assert set(got) == {"Analyst", "Document Processing", "Functions"}
    assert got["Analyst"]["status"] == "Within range" and got["Document Processing"]["status"] == "Verify"
    assert got["Document Processing"]["observed_rate"] == pytest.approx(50.0) and got["Functions"]["status"] == "No baseline"


def test_request_baseline_personas_and_checks(usage):
    df = usage([(0, "Analyst", 1, 100, 6.7), (1, "Analyst", 1, 100, 6.7), (0, "Search", 1, 0, 5.0)])
    base = analytics.request_baseline(df)
    got = {r["service_type"]: r for r in rows(base)}
    assert got["Analyst"]["requests_per_day"] == 100.0 and got["Analyst"]["cost_per_request"] == pytest.approx(0.201)
    assert got["Search"]["cost_per_request"] == 0.0
    checks = {r["service_type"]: r for r in rows(analytics.baseline_checks(base))}
    assert checks["Analyst"]["rate_status"] == "matches" and checks["Search"]["has_no_operations"]
    assert checks["Analyst"]["has_low_coverage"] and not checks["Analyst"]["has_high_request_cost"]
    personas = {r["persona"]: r for r in rows(analytics.persona_costs(base))}
    assert personas["Power User"]["cost_per_user_month"] == pytest.approx(50 * 30 * 0.201)
    published = {r["persona"]: r for r in rows(analytics.persona_costs(base, published_rate=True))}
    assert published["Regular User"]["total_monthly_cost"] == pytest.approx(20 * 30 * 0.201 * 30)
    totals = one(analytics.persona_totals(analytics.persona_costs(base)))
    assert totals["total_users"] == 40 and totals["total_monthly_requests"] == 50 * 30 * 10 + 20 * 30 * 30


def test_benchmark_bands(usage):
    df = usage([(0, "Analyst", 1, 1, 0.2), (0, "Search", 1, 1, 0.01), (0, "Other", 1, 1, 1.0)])
    got = {r["service_type"]: r["band"] for r in rows(analytics.benchmark_band(df))}
    assert got == {"Analyst": "typical to high", "Search": "low to typical", "Other": "no benchmark"}


def test_rate_card(spark):
    summary = spark.createDataFrame(
        [("COMPLETE", "mistral-7b", 2_000_000, 0.2, 0.1), ("TRANSLATE", "mistral-7b", 1_000_000, 1.0, 1.0), ("COMPLETE", "own", 1, 1.0, 1.0), ("COMPLETE", None, 1, 1.0, 1.0)],
        "function_name STRING, model_name STRING, total_tokens BIGINT, total_credits DOUBLE, cost_per_million_tokens DOUBLE",
    )
    got = {(r["function_name"], r["model_name"]): r for r in rows(analytics.rate_card_join(summary, *analytics.rate_card(spark)))}
    assert got["COMPLETE", "mistral-7b"]["rate_status"] == "Within published rate"
    assert got["TRANSLATE", "mistral-7b"]["rate_low"] == 0.056 and got["TRANSLATE", "mistral-7b"]["rate_status"] == "Above published rate"
    assert got["COMPLETE", "own"]["rate_status"] == got["COMPLETE", None]["rate_status"] == "No published rate"


def test_user_cost_calculator_shares(usage):
    got = rows(analytics.cost_per_user_calculator(usage([(0, "A", 1, 10, 10.0), (0, "B", 1, 10, 30.0)])))
    assert sum(r["pct_of_user_cost"] for r in got) == pytest.approx(100.0)
    assert {r["service_type"]: r["credits_per_user_month"] for r in got} == {"A": 440.0, "B": 1320.0}
