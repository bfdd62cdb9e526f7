"""Upsert for file tables, which have no MERGE.

``upsert`` is the plain DataFrame form. ``merge_into`` applies it to a partitioned parquet table: it reads and rewrites
only the partitions the source touches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def _key(column: Column, null_is_empty: bool) -> Column:
    return F.coalesce(column, F.lit("")) if null_is_empty else column


def upsert(
    target: DataFrame,
    source: DataFrame,
    *,
    keys: Sequence[str],
    update_cols: Sequence[str],
    insert_cols: Sequence[str],
    on_update: Mapping[str, Column] | None = None,
    on_insert: Mapping[str, Column] | None = None,
    null_is_empty: Sequence[str] = (),
) -> DataFrame:
    """Target with the source merged in, in the target's column order.

    Matched rows take ``update_cols`` from the source and ``on_update`` values; unmatched source rows are inserted with
    ``insert_cols`` and ``on_insert`` values, other columns NULL. For keys in ``null_is_empty``, NULL equals ''.
    """
    on_update, on_insert = dict(on_update or {}), dict(on_insert or {})
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    s = source.withColumn("_in_source", F.lit(True)).alias("s")
    condition = reduce(
        lambda a, b: a & b,
        [_key(F.col(f"t.{k}"), k in null_is_empty) == _key(F.col(f"s.{k}"), k in null_is_empty) for k in keys],
    )
    joined = t.join(s, condition, "full_outer")
    kept = F.col("_in_target").isNotNull()
    matched = kept & F.col("_in_source").isNotNull()
    out = []
    for field in target.schema.fields:
        name = field.name
        old = F.col(f"t.{name}")
        if name in on_update:
            updated = on_update[name]
        else:
            updated = F.col(f"s.{name}") if name in update_cols else old
        if name in on_insert:
            inserted = on_insert[name]
        else:
            inserted = F.col(f"s.{name}") if name in insert_cols else F.lit(None)
        out.append(
            F.when(matched, updated).when(kept, old).otherwise(inserted).cast(field.dataType).alias(name)
        )
    return joined.select(*out)


def read_table(source: DataFrame, path: str, schema: StructType) -> DataFrame:
    """The stored table, or an empty one where nothing has been written yet."""
    spark = source.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def remove(spark, path: str) -> None:
    """Remove a folder that this code has made."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def merge_into(path: str, source: DataFrame, *, partition_col: str, schema: StructType, **upsert_args) -> None:
    """Merge ``source`` into the parquet table at ``path``, partitioned by ``partition_col``.

    The source is computed once into the shared folder. The first and last partition it touches (one row on the driver)
    bound the part of the target that is read; merged partitions are written to the shared folder and then replace the
    old ones, so nothing is read from a place being written. A rerun after a lost job gives the same table. A source that
    holds a key twice is rejected before anything is written. The two staging folders are removed at the end.
    """
    spark = source.sparkSession
    staged_source = scratch_path(spark, "merge-source")
    source.write.parquet(staged_source)
    fresh = spark.read.schema(source.schema).parquet(staged_source)
    keys = [_key(F.col(k), k in upsert_args.get("null_is_empty", ())) for k in upsert_args["keys"]]
    low, high = fresh.agg(F.min(partition_col), F.max(partition_col)).first()
    twice = fresh.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if low is None or twice:
        remove(spark, staged_source)
        if twice:
            raise ValueError(f"the source holds a key twice: {', '.join(upsert_args['keys'])}")
        return
    touched = fresh.select(partition_col).distinct()
    target = (
        read_table(fresh, path, schema)
        .where(F.col(partition_col).between(F.lit(low), F.lit(high)))
        .join(touched, partition_col, "left_semi")
        .select(*schema.names)
    )
    staged_merge = scratch_path(spark, "merge-result")
    upsert(target, fresh, **upsert_args).write.parquet(staged_merge)
    (
        spark.read.schema(schema).parquet(staged_merge)
        .hint("rebalance", partition_col)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col)
        .parquet(path)
    )
    remove(spark, staged_source)
    remove(spark, staged_merge)
