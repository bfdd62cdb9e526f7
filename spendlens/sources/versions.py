"""Partitioned tables that change from one whole state to the next.

A change writes its partitions to a new folder and then switches one pointer, so a reader sees the table before the change or after
it, never half of it, and a job that dies before the switch has changed nothing. A pointer is a small numbered file that names the
folder of every partition; the largest number counts. Two changes at a time can't both take the next number: one of them fails and
is run again. This is a pointer, no table format: no statistics, no schema, no log.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from .upsert import _key, remove, upsert

_POINTERS, _PART = "_pointers", "_part"
NULL_PART = "__HIVE_DEFAULT_PARTITION__"


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    place, fs = _path(spark, f"{root}/{_POINTERS}")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n) for n in names if n.isdigit())


def pointer(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """Number of the newest pointer, or the given one, and the folder of each partition; (0, {}) for a table without any."""
    numbers = _numbers(spark, root)
    if not numbers:
        return 0, {}
    number = numbers[-1] if number is None else number
    text = spark.read.option("wholetext", True).text(f"{root}/{_POINTERS}/{number}").first()[0]
    return number, json.loads(text)


def switch(spark: SparkSession, root: str, number: int, partitions: dict[str, str]) -> None:
    """Makes these partitions the table, if `number` still follows the newest pointer."""
    place, fs = _path(spark, f"{root}/{_POINTERS}/{number}")
    draft, _ = _path(spark, f"{root}/{_POINTERS}/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(partitions).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise RuntimeError(f"another change of {root} came first; run this one again")


def read_published(
    spark: SparkSession, root: str, schema: StructType, partitions: list[str] | None = None, number: int | None = None
) -> DataFrame:
    """The table as of its newest pointer, or an earlier one; of some partitions, if these are named."""
    _, known = pointer(spark, root, number)
    folders = [f"{root}/{f}" for p, f in sorted(known.items()) if partitions is None or p in partitions]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_partitions(table: DataFrame, root: str, partition_col: str) -> dict[str, str]:
    """Writes a table's partitions to a new folder, which no pointer names yet. The partition column stays in the files."""
    spark, version = table.sparkSession, f"data/{uuid.uuid4().hex}"
    (
        table.withColumn(_PART, F.col(partition_col).cast("string")).hint("rebalance", _PART)
        .write.partitionBy(_PART).parquet(f"{root}/{version}")
    )
    place, fs = _path(spark, f"{root}/{version}")
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return {unquote(n.removeprefix(f"{_PART}=")): f"{version}/{n}" for n in names if n.startswith(f"{_PART}=")}


def publish_merge(
    root: str, source: DataFrame, *, partition_col: str, schema: StructType, before_switch=None, **upsert_args
) -> int:
    """Merges `source` into the published table and returns the number of the new pointer.

    Only partitions that the source touches are read and written. A source that holds a key twice is rejected before anything is
    written; an empty one changes nothing. `before_switch` is called when everything is written and nothing is visible yet.
    """
    spark = source.sparkSession
    staged = scratch_path(spark, "publish-source")
    source.write.parquet(staged)
    fresh = spark.read.schema(source.schema).parquet(staged)
    keys = [_key(F.col(k), k in upsert_args.get("null_is_empty", ())) for k in upsert_args["keys"]]
    if not fresh.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        remove(spark, staged)
        raise ValueError(f"the source holds a key twice: {', '.join(upsert_args['keys'])}")
    touched = [r[0] for r in fresh.select(F.col(partition_col).cast("string")).distinct().collect()]  # partitions of one change
    number, known = pointer(spark, root)
    if touched:
        target = read_published(spark, root, schema, [NULL_PART if p is None else p for p in touched], number if known else None)
        new = write_partitions(upsert(target, fresh, **upsert_args), root, partition_col)
        if before_switch is not None:
            before_switch()
        switch(spark, root, number + 1, known | new)
        number += 1
    remove(spark, staged)
    return number


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Removes what only pointers older than the newest `keep` name, and what none names; returns the number of folders that went.

    Not for the time of a change: its folder has no pointer yet.
    """
    numbers = _numbers(spark, root)
    used = {f for n in numbers[-keep:] for f in pointer(spark, root, n)[1].values()}
    place, fs = _path(spark, f"{root}/data")
    gone = 0
    for version in fs.listStatus(place) if fs.exists(place) else []:
        folder = f"data/{version.getPath().getName()}"
        parts = [f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(version.getPath())]
        unused = [p for p in parts if p.rsplit("/", 1)[1].startswith(f"{_PART}=") and p not in used]
        for p in unused:
            remove(spark, f"{root}/{p}")
        gone += len(unused)
        if not any(p in used for p in parts):
            remove(spark, f"{root}/{folder}")
    for n in numbers[:-keep]:
        remove(spark, f"{root}/{_POINTERS}/{n}")
    return gone
