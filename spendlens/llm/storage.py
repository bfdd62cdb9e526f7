"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.session import scratch_path

BATCH_ROWS = 256  # rows of one Arrow batch: texts may be long


def prepared(spark: SparkSession) -> SparkSession:
    """Settings that the operators with Python workers rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def written(table: DataFrame, name: str) -> DataFrame:
    """The table, computed once, written to a new folder and read back: it outlives lost executors."""
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def fresh(table: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the table has."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
