"""Seasonal forecasts and sliding active users against plain versions."""

import math
import random
from datetime import date, timedelta

import pytest
from shared import rows

from spendlens.operators.active_users import active_users_sliding
from spendlens.operators.seasonal import GRID, daily_arrays, forecast_backtest, forecast_seasonal

FIRST = date(2025, 1, 6)


def series(spark, values, name="S"):
    data = [(name, FIRST + timedelta(days=i), float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(data, "service_type STRING, ts DATE, y DOUBLE")


def plain(ys, horizon):
    """(forecast, width) per day ahead, by plain loops over all parameters."""
    n = len(ys)
    held = max(7, n // 5)
    best = None
    for number, alpha, beta, gamma, _, _ in GRID:
        level = sum(ys[:7]) / 7
        trend, season, sse = (sum(ys[7:14]) / 7 - level) / 7, [y - level for y in ys[:7]], 0.0
        for t in range(7, n):
            e = ys[t] - (level + trend + season[t % 7])
            level, trend = level + trend + alpha * e, trend + alpha * beta * e
            season[t % 7] += gamma * (1 - alpha) * e
            sse += e * e if t >= n - held else 0.0
        if best is None or sse < best[0] - 1e-12 * abs(best[0]):
            best = (sse, alpha, beta, gamma, level, trend, season)
    sse, alpha, beta, gamma, level, trend, season = best
    out = []
    for h in range(1, horizon + 1):
        steps = [alpha + alpha * beta * j + (gamma * (1 - alpha) if j % 7 == 0 else 0) for j in range(1, h)]
        out.append((level + h * trend + season[(n + h - 1) % 7], 1.96 * math.sqrt(sse / held * (1 + sum(c * c for c in steps)))))
    return out


def test_equals_plain_smoothing(spark):
    random.seed(3)
    ys = [100 + 0.8 * i + 15 * math.sin(i % 7) + random.random() * 9 for i in range(75)]
    got = rows(forecast_seasonal(series(spark, ys), horizon_days=40).orderBy("forecast_date"))
    expected = plain(ys, 40)
    assert [r["forecast_date"] for r in got] == [FIRST + timedelta(days=74 + h) for h in range(1, 41)]
    for r, (value, width) in zip(got, expected):
        assert r["forecast_credits"] == pytest.approx(value) and r["status"] == "OK"
        assert r["upper_bound_credits"] == pytest.approx(value + width) and r["lower_bound_credits"] == pytest.approx(max(0, value - width))


def test_follows_the_weekdays_and_beats_a_line(spark):
    ys = [50 if i % 7 < 5 else 5 for i in range(84)]
    got = rows(forecast_seasonal(series(spark, ys), horizon_days=14).orderBy("forecast_date"))
    assert [round(r["forecast_credits"]) for r in got] == [50] * 5 + [5, 5] + [50] * 5 + [5, 5]
    tested = {r["model"]: r for r in rows(forecast_backtest(series(spark, [y + i * 0.3 for i, y in enumerate(ys)])))}
    assert tested["seasonal"]["best"] and not tested["linear"]["best"] and tested["seasonal"]["days"] == 21
    assert tested["seasonal"]["mean_absolute_error"] < 0.5 < tested["last_week"]["mean_absolute_error"] < tested["linear"]["mean_absolute_error"]


def test_days_without_usage_and_short_series(spark):
    ys = [10.0 if i % 3 else None for i in range(40)]
    one = rows(daily_arrays(series(spark, ys)))[0]
    assert one["ys"] == [0.0 if v is None else v for v in ys[1:-1]] and one["first_day"] == FIRST + timedelta(days=1)
    both = series(spark, [1.0] * 20, "short").unionByName(series(spark, [2.0] * 21, "enough"))
    got = rows(forecast_seasonal(both, horizon_days=3).orderBy("service_type"))
    assert [(r["service_type"], r["status"], r["forecast_credits"]) for r in got] == [("enough", "OK", 2.0)] * 3 + [("short", "TOO_SHORT", None)]
    assert rows(forecast_backtest(both)) == [] and rows(forecast_seasonal(series(spark, []))) == []


def test_tiny_credits_are_not_lost(spark):
    got = rows(forecast_seasonal(series(spark, [0.0000003] * 30), horizon_days=1))
    assert got[0]["forecast_credits"] == pytest.approx(0.0000003)


@pytest.mark.parametrize("seed", [1, 2])
def test_active_users_equal_counting_each_window(spark, seed):
    random.seed(seed)
    data = [(FIRST + timedelta(days=random.randrange(60)), random.choice("abcdefgh"), random.choice(["X", "Y", "Z"])) for _ in range(150)]
    usage = spark.createDataFrame(data + data[:20] + [(FIRST, None, "X"), (None, "a", "X")], "usage_date DATE, user_name STRING, service_type STRING")
    end = FIRST + timedelta(days=50)
    got = {(r["service_type"], r["usage_date"]): (r["users_1d"], r["users_7d"], r["users_30d"])
           for r in rows(active_users_sliding(usage, as_of=end))}
    expected = {}
    for service in ("X", "Y", "Z", "All"):
        mine = [(d, u) for d, u, s in data if service in (s, "All") and d <= end]
        day = min(d for d, _ in mine)
        while day <= end:
            expected[service, day] = tuple(len({u for d, u in mine if day - timedelta(days=w) < d <= day}) for w in (1, 7, 30))
            day += timedelta(days=1)
    assert got == expected
