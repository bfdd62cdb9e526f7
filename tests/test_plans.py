"""What the physical plans must and must not contain."""

import pytest
from shared import SF
from pyspark.sql import functions as F

from spendlens.functions.columns import present
from spendlens.operators import attribution, rollups, snapshot
from spendlens.plans import queries
from spendlens.session import scratch_path
from spendlens.sources.schemas import SCHEMAS, TIME_COLUMN, struct
from spendlens.sources.telemetry import Telemetry

# these write files while they are built
BUILT_BY_JOBS = {
    "csv_ingest", "csv_ingest_gzip", "stream_daily_usage", "stream_daily_usage_sketched", "query_cost_analysis", "top_queries",
    "snapshot_job", "check_results_stored", "snapshot_published",
    "check_results_views", "check_results_views_faulty",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Plans as on data too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bed = queries.Bed(spark, SF)
        yield {n: plan(present(make(bed))) for n, make in queries.QUERIES.items() if n not in BUILT_BY_JOBS}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_cross_joins_forced_broadcasts_or_python(plans):
    for name, text in plans.items():
        for forbidden in ("CartesianProduct", "NestedLoopJoin", "BroadcastExchange", "PythonUDF", "InPandas", "ExistingRDD"):
            assert forbidden not in text, (name, forbidden)


def test_projections_do_not_shuffle(plans):
    for name in ("lookback_scan", "analyst_detail", "search_serving_detail", "document_legacy_detail", "fine_tuning_detail", "text_chunks", "non_ascii_docs"):
        assert "Exchange" not in plans[name], name


def test_top_k_is_cut_before_the_shuffle(plans):
    for name in ("top_users", "anomaly_top10", "top_functions"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_scans_read_only_needed_columns(plans):
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plans["data_maturity"]


def test_time_filters_reach_the_scan(plans):
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00" in plans["lookback_scan"]


def test_filter_on_a_service_drops_the_other_branches(spark):
    bed = queries.Bed(spark, SF)
    text = plan(bed.daily.where(F.col("service_type") == "Fine-tuning"))
    assert text.count("FileScan") == 1


def test_model_comparison_counts_without_expanding_records(plans):
    assert "Expand" not in plans["model_comparison"]


def test_fact_scans_carry_a_time_filter(spark):
    """On telemetry stored as files, no query of these reads a usage table without its time bound."""
    root, times = scratch_path(spark, "stored-telemetry"), set(TIME_COLUMN.values())
    for name, ddl in SCHEMAS.items():
        spark.createDataFrame([], struct(ddl)).write.parquet(f"{root}/{name}")
    t = Telemetry.read(spark, root)
    for make in (rollups.daily_summary, attribution.user_spend_attribution, snapshot.usage_by_feature):
        text = make(t, as_of=queries.AS_OF)._jdf.queryExecution().simpleString()
        for scan in [line for line in text.splitlines() if "FileScan" in line and "struct<user_id:bigint,name:string>" not in line]:
            assert any(f"GreaterThanOrEqual({c}" in scan for c in times), scan
