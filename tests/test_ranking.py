"""Ranks and quantiles against brute force, on skewed and tied values."""

import glob
import os
import random
import re
from decimal import Decimal

import numpy as np
import pytest

from spendlens.functions.ranking import band, exact_quantiles, rank_rows
from spendlens.session import shared_folder


def skewed(seed, n=3000):
    """A third of the rows share one value, a third are fully equal rows, the rest are spread over magnitudes."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = i % 3
        group = "big" if rng.random() < 0.8 else "small"
        if kind == 0:
            out.append((group, f"q{i}", Decimal("5.000000")))
        elif kind == 1:
            out.append((group, "same", Decimal("7.250000")))
        else:
            out.append((group, f"q{i}", Decimal(f"{rng.lognormvariate(0, 4) + 1e-6:.6f}")))
    return out


@pytest.mark.parametrize("block_rows", [1 << 20, 7])
def test_ranks_are_a_total_order(spark, block_rows):
    data = skewed(1)
    df = spark.createDataFrame(data, "g STRING, id STRING, v DECIMAL(18,6)")
    got = rank_rows(df, ["g"], "v", "r", block_rows=block_rows).collect()
    assert sorted((r.g, r.id, r.v) for r in got) == sorted(data)
    for group in ("big", "small"):
        mine = sorted((r for r in got if r.g == group), key=lambda r: r.r)
        assert [r.r for r in mine] == list(range(1, len(mine) + 1))
        assert all(a.v >= b.v for a, b in zip(mine, mine[1:]))


def test_ranks_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(skewed(2), "g STRING, id STRING, v DECIMAL(18,6)")
    first = sorted(rank_rows(df.repartition(3), ["g"], "v").collect())
    second = sorted(rank_rows(df.repartition(11, "id"), ["g"], "v").collect())
    assert first == second


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [3.0] * 50, [-5.0, -1.0, 0.0, 0.0, 2.5, 1e-9, 1e9],
    [random.Random(3).lognormvariate(0, 3) for _ in range(501)],
])
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 4.0)], "g STRING, v DOUBLE")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"q0": 0.0, "q50": 0.5, "q90": 0.9, "q100": 1.0}).collect()}
    for name, p in (("q0", 0), ("q50", 50), ("q90", 90), ("q100", 100)):
        assert got["a"][name] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-12)
    assert got["b"].q50 == 4.0


def test_bands_follow_the_values(spark):
    values = sorted([-1e300, -2.0, -1.0, -1e-300, 0.0, 5e-324, 1e-9, 0.999, 1.0, 1.0001, 3.0, 1e300])
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", band("v").alias("b"))
    bands = [r.b for r in df.orderBy("v").collect()]
    assert bands == sorted(bands)


def test_close_values_are_spread_over_tasks(spark):
    """A million distinct values within 0.3 % of each other: no window holds more than a few of the ranges' rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1_000_000).selectExpr("'a' AS g", "CAST(100 + id / 3500000 AS DECIMAL(18,9)) AS v", "id")
        ranked = rank_rows(df, ["g"], "v", "r")
        path = max(glob.glob(f"{shared_folder(spark)}/ranked-ranges-*"), key=os.path.getmtime)
        sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_range").count().collect()]
        assert max(sizes) < 100_000
        assert ranked.where("r <> 1000000 - id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_window_holds_the_rows_of_a_whole_group(spark):
    """The only window partitioned by the group alone runs over the totals of the ranges."""
    df = spark.createDataFrame([("a", 1, 1.0)], "g STRING, id BIGINT, v DOUBLE")
    plan = rank_rows(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?) (?:ASC|DESC) NULLS", plan)
    assert specs
    for spec in specs:
        names = [c.split("#")[0] for c in spec.split(", ")]
        assert names == ["g", "_range"] or names[:2] == ["g", "_range"]
