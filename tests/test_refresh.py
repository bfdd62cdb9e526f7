"""Anomalies that are refreshed by changed days against the full run."""

import random
from datetime import date, datetime, timedelta

import pytest
from shared import rows
from pyspark.sql import functions as F

from spendlens.operators import anomalies, rollups

FIRST = date(2025, 1, 1)


def table(spark, days):
    data = [(FIRST + timedelta(days=d), s, 1 + d % 3, 10, float(v)) for (s, d), v in days.items()]
    return rollups.with_ratios(spark.createDataFrame(
        data, "usage_date DATE, service_type STRING, daily_unique_users BIGINT, total_operations BIGINT, total_credits DOUBLE"
    ).withColumn("total_credits", F.col("total_credits").cast("decimal(38,12)")))


@pytest.mark.parametrize("calendar", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_full_run_after_random_changes(spark, seed, calendar):
    random.seed(seed)
    scope = {"as_of": datetime(2025, 4, 1), "calendar": calendar}
    before = {(s, d): random.randrange(1, 100) for s in "ABC" for d in range(85) if random.random() < 0.8}
    after = dict(before)
    for _ in range(4):
        key = random.choice("AB"), random.randrange(85)
        if key in after and random.random() < 0.4:
            del after[key]
        else:
            after[key] = random.randrange(1, 100)
    changed = [(s, FIRST + timedelta(days=d)) for s, d in before.keys() | after.keys() if before.get((s, d)) != after.get((s, d))]
    marks = spark.createDataFrame(changed, "service_type STRING, usage_date DATE")
    stored = anomalies.cost_anomalies(table(spark, before), **scope)
    got = anomalies.refresh_anomalies(stored, table(spark, after), marks, **scope)
    expected = anomalies.cost_anomalies(table(spark, after), **scope)
    assert sorted(map(repr, rows(got.select(expected.columns)))) == sorted(map(repr, rows(expected)))


def test_nothing_changed_and_nothing_stored(spark):
    scope = {"as_of": datetime(2025, 4, 1)}
    days = table(spark, {("A", d): d + 1 for d in range(30)})
    full = anomalies.cost_anomalies(days, **scope)
    none = days.where("false")
    assert sorted(map(repr, rows(anomalies.refresh_anomalies(full, days, none, **scope)))) == sorted(map(repr, rows(full)))
    first = anomalies.refresh_anomalies(full.where("false"), days, days, **scope)
    assert sorted(map(repr, rows(first))) == sorted(map(repr, rows(full)))
