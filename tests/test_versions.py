"""Published tables: a reader sees all of a change or nothing."""

import pytest
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType
from shared import rows

from spendlens.session import scratch_path
from spendlens.sources import versions

SCHEMA = StructType([StructField("day", DateType()), StructField("k", StringType()), StructField("v", LongType())])
MERGE = {"partition_col": "day", "schema": SCHEMA, "keys": ["day", "k"], "update_cols": ["v"], "insert_cols": ["day", "k", "v"]}


def source(spark, *values):
    return spark.createDataFrame([(d, k, v) for d, k, v in values], "day STRING, k STRING, v BIGINT").selectExpr("CAST(day AS DATE) AS day", "k", "v")


def content(spark, root, **options):
    return sorted((str(r["day"]), r["k"], r["v"]) for r in rows(versions.read_published(spark, root, SCHEMA, **options)))


def test_a_change_that_stops_before_the_switch_is_not_seen(spark):
    root = scratch_path(spark, "published")
    assert content(spark, root) == []
    assert versions.publish_merge(root, source(spark, ("2025-01-01", "a", 1), ("2025-01-02", "b", 2)), **MERGE) == 1
    before = versions.read_published(spark, root, SCHEMA)

    def stop():
        raise KeyboardInterrupt

    change = source(spark, ("2025-01-02", "b", 20), ("2025-01-03", "c", 3))
    with pytest.raises(KeyboardInterrupt):
        versions.publish_merge(root, change, before_switch=stop, **MERGE)
    old = [("2025-01-01", "a", 1), ("2025-01-02", "b", 2)]
    assert content(spark, root) == old
    # the job runs again; who began to read before goes on with the old state
    assert versions.publish_merge(root, change, **MERGE) == 2
    new = [("2025-01-01", "a", 1), ("2025-01-02", "b", 20), ("2025-01-03", "c", 3)]
    assert content(spark, root) == new and sorted(r["v"] for r in rows(before)) == [1, 2]
    assert content(spark, root, number=1) == old and content(spark, root, partitions=["2025-01-03"]) == new[2:]
    # again: nothing changes but the number
    assert versions.publish_merge(root, change, **MERGE) == 3 and content(spark, root) == new


def test_of_two_changes_at_a_time_one_fails(spark):
    root = scratch_path(spark, "published")
    versions.publish_merge(root, source(spark, ("2025-01-01", "a", 1)), **MERGE)

    def other():
        versions.publish_merge(root, source(spark, ("2025-01-01", "a", 5)), **MERGE)

    with pytest.raises(RuntimeError, match="came first"):
        versions.publish_merge(root, source(spark, ("2025-01-01", "a", 9)), before_switch=other, **MERGE)
    assert content(spark, root) == [("2025-01-01", "a", 5)]


def test_missing_days_empty_sources_and_repeated_keys(spark):
    root = scratch_path(spark, "published")
    assert versions.publish_merge(root, source(spark), **MERGE) == 0
    versions.publish_merge(root, source(spark, (None, "x", 1), ("2025-01-01", "a", 1)), **MERGE)
    versions.publish_merge(root, source(spark, ("2025-01-01", "a", 2)), **MERGE)
    assert content(spark, root) == [("2025-01-01", "a", 2), ("None", "x", 1)]
    with pytest.raises(ValueError, match="twice"):
        versions.publish_merge(root, source(spark, ("2025-01-01", "a", 2), ("2025-01-01", "a", 3)), **MERGE)


def test_vacuum_keeps_what_newer_pointers_name(spark):
    root = scratch_path(spark, "published")
    for v in range(4):
        versions.publish_merge(root, source(spark, ("2025-01-01", "a", v), *([("2025-01-02", "b", 0)] if not v else [])), **MERGE)
    assert versions.vacuum(spark, root, keep=2) == 2
    assert content(spark, root) == [("2025-01-01", "a", 3), ("2025-01-02", "b", 0)]
    assert content(spark, root, number=3) == [("2025-01-01", "a", 2), ("2025-01-02", "b", 0)]
    assert versions.vacuum(spark, root, keep=2) == 0
