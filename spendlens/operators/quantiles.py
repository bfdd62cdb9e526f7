"""Approximate credit quantiles from mergeable summaries.

A summary per day and model is a few kilobytes, whatever the number of records; summaries of any days merge into one that gives
any quantile, without the records. The rank of an answer is off by about `RANK_ERROR` at most.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dbl
from ..sources.telemetry import Telemetry

#: items a summary keeps on its levels, and the rank error that this size is given with (99 of 100 answers)
SIZE, RANK_ERROR = 400, 0.007
QUANTILES = {"median_credits": 0.50, "p90_credits": 0.90, "p99_credits": 0.99}


def credit_summaries(t: Telemetry, *, as_of: datetime, lookback_days: int = 90, size: int = SIZE) -> DataFrame:
    """One row per day and model: records with credits, and a quantile summary of the credits. A table of these is kept and
    added to day by day."""
    return (
        t.recent("functions", as_of, lookback_days)
        .where(F.col("model_name").isNotNull() & F.col("token_credits").isNotNull())
        .groupBy(F.col("usage_time").cast("date").alias("usage_date"), "model_name")
        .agg(F.count(F.lit(1)).alias("records"), F.kll_sketch_agg_double(dbl("token_credits"), size).alias("summary"))
    )


def credit_quantiles(
    summaries: DataFrame, *, first: date, last: date, quantiles: Mapping[str, float] = QUANTILES
) -> DataFrame:
    """Quantiles per model over the days from ``first`` to ``last``, from their summaries alone."""
    merged = (
        summaries.where(F.col("usage_date").between(F.lit(first), F.lit(last)))
        .groupBy("model_name").agg(F.sum("records").alias("records"), F.kll_merge_agg_double("summary").alias("summary"))
    )
    return merged.select(
        "model_name", "records",
        *[F.kll_sketch_get_quantile_double("summary", F.lit(float(p))).alias(name) for name, p in quantiles.items()],
    )


def rank_errors(
    answers: DataFrame, t: Telemetry, *, first: date, last: date, quantiles: Mapping[str, float] = QUANTILES
) -> DataFrame:
    """How far the rank of each answer is from the wanted one, as a share of the records: 0 where the wanted rank is one that
    records with exactly this value have. Reads the records once; equal values travel as one row."""
    day = F.col("usage_time").cast("date")
    start = F.lit(first.isoformat()).cast("timestamp_ntz")
    values = (
        t.functions.where((F.col("usage_time") >= start) & day.between(F.lit(first), F.lit(last)))
        .where(F.col("model_name").isNotNull() & F.col("token_credits").isNotNull())
        .groupBy("model_name", dbl("token_credits").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    )

    def off(name: str, p: float) -> Column:
        below = F.sum(F.when(F.col("_value") < F.col(name), F.col("_n")).otherwise(0)) / F.sum("_n")
        up_to = F.sum(F.when(F.col("_value") <= F.col(name), F.col("_n")).otherwise(0)) / F.sum("_n")
        return F.greatest(F.lit(0.0), below - F.lit(p), F.lit(p) - up_to).alias(f"{name}_rank_error")

    return (
        values.join(answers, "model_name").groupBy("model_name", "records")
        .agg(F.sum("_n").alias("exact_records"), *[off(name, p) for name, p in quantiles.items()])
    )
