"""Daily usage from streams: several streams over the same tables, compacted parts, sketches of users."""

import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from shared import rows

from spendlens.session import scratch_path
from spendlens.sources.schemas import struct
from spendlens.streaming import daily_usage as stream

SCHEMA = "event_time TIMESTAMP, service_type STRING, user BIGINT, operations BIGINT, credits DECIMAL(18,6)"


class Feed:
    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.source, self.table, self.parts, self.checkpoint = (scratch_path(spark, n) for n in ("events", "daily", "parts", "state"))

    def send(self, *events):
        data = [(None if d is None else datetime(2025, 1, d, 5), s, u, 1, None) for d, s, u in events]
        self.spark.createDataFrame(data, SCHEMA).withColumn("credits", F.lit(0.5).cast("decimal(18,6)")).write.mode("append").parquet(self.source)
        return self.run()

    def run(self):
        events = self.spark.readStream.schema(SCHEMA).parquet(self.source)
        stream.start_daily_usage(
            events, path=self.table, parts=self.parts, checkpoint=self.checkpoint, availableNow=True, **self.options).awaitTermination()
        return {(r["usage_date"] and r["usage_date"].day, r["service_type"]): (r["events"], float(r["total_credits"]), r["users"])
                for r in rows(self.spark.read.schema(stream.DAILY_SCHEMA).parquet(self.table))}


@pytest.mark.parametrize("users", ["exact", "sketch"])
@pytest.mark.parametrize("closed_days", [None, 0, 2])
def test_a_second_checkpoint_adds_to_the_same_tables(spark, users, closed_days):
    feed = Feed(spark, users=users, closed_days=closed_days)
    feed.send((10, "A", 1), (None, "A", 1))
    feed.source, feed.checkpoint = scratch_path(spark, "events"), scratch_path(spark, "state")
    assert feed.send((10, "A", 2), (11, "B", 1)) == {(10, "A"): (2, 1.0, 2), (11, "B"): (1, 0.5, 1), (None, "A"): (1, 0.5, 1)}
    # both streams were the first batch of theirs
    assert feed.send((10, "A", 1), (20, "A", None))[10, "A"] == (3, 1.5, 2)


@pytest.mark.parametrize("users", ["exact", "sketch"])
def test_parts_of_closed_days_are_compacted(spark, users):
    feed = Feed(spark, users=users, closed_days=2)
    for n in range(4):
        feed.send((1, "A", n), (1, "B", 1), (2, "A", n))
    assert len(glob.glob(f"{feed.parts}/usage_date=2025-01-01/run=*/level=0/batch=*")) == 4
    after = feed.send((9, "A", 1))
    assert glob.glob(f"{feed.parts}/usage_date=2025-01-0[12]/run=*/level=0") == []
    one = spark.read.parquet(f"{feed.parts}/usage_date=2025-01-01")
    assert one.count() == (5 if users == "exact" else 2)  # users by service, or services
    assert after == {(1, "A"): (4, 2.0, 4), (1, "B"): (4, 2.0, 1), (2, "A"): (4, 2.0, 4), (9, "A"): (1, 0.5, 1)}
    # a late event of a closed day, compacted once more
    assert feed.send((1, "A", 1), (1, "A", 77))[1, "A"] == (6, 3.0, 5)
    assert len(glob.glob(f"{feed.parts}/usage_date=2025-01-01/run=*/level=*/batch=*")) == 1


def test_batches_that_a_compacted_part_holds_are_ignored(spark):
    """As after a stop between the two steps, or when the last batch runs again."""
    feed = Feed(spark, users="exact")
    feed.send((1, "A", 1), (1, "A", 2))
    feed.send((1, "A", 1))
    before = rows(stream.read_parts(spark, feed.parts, ["2025-01-01"]))
    kept = spark.read.schema(stream.parts_schema("exact")).parquet(feed.parts).select(*struct(stream.parts_schema("exact")).names).collect()
    stream.compact_parts(spark, feed.parts, ["2025-01-01"])
    stream._write(spark.createDataFrame(kept, stream.parts_schema("exact")), feed.parts, "usage_date", "run", "level", "batch")
    found = rows(stream.daily_usage(stream.read_parts(spark, feed.parts, ["2025-01-01"])))
    assert len(before) == 3 and [(r["events"], r["users"]) for r in found] == [(3, 2)]


def test_estimates_are_near_the_exact_number(spark):
    feed = Feed(spark, users="sketch", closed_days=0)
    spark.range(30_000).selectExpr(
        "TIMESTAMP'2025-01-03 00:00:00' AS event_time", "concat('S', id % 2) AS service_type", "id % 9000 AS user", "id AS operations",
        "CAST(1 AS DECIMAL(18,6)) AS credits").write.parquet(feed.source)
    feed.run()
    again = feed.send((3, "S0", 1), (5, "S0", 2))
    assert abs(again[3, "S0"][2] - 4500) < 5 * 0.0163 * 4500 and again[3, "S0"][0] == 15_001


def test_unknown_kind_of_users_is_refused(spark):
    with pytest.raises(ValueError, match="exact, sketch"):
        stream.start_daily_usage(spark.range(1), path="p", parts="q", checkpoint="c", users="some")
