"""Daily usage from a stream of usage events, kept in a stored table that is complete whatever the batches are.

Every micro-batch adds its own counts to a table of parts and then makes the days it touched anew from all their parts. There is
no watermark: an event that comes late changes its day like any other. A batch that runs again replaces its own parts, so a
repeat after a failure changes nothing. Parts belong to a stream and a batch, so a second stream, or a new checkpoint, adds to the
same tables.

Users are counted exactly (a part has a row per user), or by mergeable sketches (a part has one row per service). The parts of a
day that is closed are compacted: a row per service, and per user where users are exact, stands for all batches up to one. Batches
up to that one are ignored from then on, so it doesn't matter when their files go, or whether the last of them runs again.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path
from ..sources.schemas import TOTAL, struct
from ..sources.upsert import remove

DAILY_SCHEMA = (
    f"usage_date DATE, service_type STRING, events BIGINT, users BIGINT, total_operations BIGINT, total_credits {TOTAL}"
)
_PLACE = "run STRING, level INT, batch BIGINT"
#: how users are kept in the parts
USERS = {"exact": "user STRING", "sketch": "sketch BINARY"}
KEYS = ["usage_date", "service_type"]
SUMS = ["events", "total_operations", "total_credits"]
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
#: log2 of a sketch's slots: a standard error of 1.04 / sqrt(4096), 1.6 %
SKETCH_BITS = 12


def parts_schema(users: str) -> str:
    return f"usage_date DATE, service_type STRING, {USERS[users]}, events BIGINT, total_operations BIGINT, total_credits {TOTAL}, {_PLACE}"


def usage_parts(events: DataFrame, users: str = "exact") -> DataFrame:
    """Counts per day and service of events with event_time, service_type, user, operations and credits; per user, or with a
    sketch of the users."""
    user = F.col("user").cast("string")
    keys = [F.col("event_time").cast("date").alias("usage_date"), F.col("service_type")]
    sums = [
        F.count(F.lit(1)).alias("events"), F.sum("operations").alias("total_operations"),
        F.sum("credits").cast(TOTAL).alias("total_credits"),
    ]
    if users == "exact":
        return events.groupBy(*keys, user.alias("user")).agg(*sums)
    return events.groupBy(*keys).agg(F.hll_sketch_agg(user, F.lit(SKETCH_BITS)).alias("sketch"), *sums)


def _combined(parts: DataFrame, users: str, *keys: str) -> DataFrame:
    """Parts of the same keys as one row."""
    sums = [F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in SUMS]
    if users == "exact":
        return parts.groupBy(*KEYS, *keys, "user").agg(*sums)
    return parts.groupBy(*KEYS, *keys).agg(F.hll_union_agg("sketch").alias("sketch"), *sums)


def daily_usage(parts: DataFrame, users: str = "exact") -> DataFrame:
    """Usage per day and service from parts that are counted once each."""
    whole = _combined(parts, users)
    if users == "exact":
        totals = [F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in SUMS]
        whole = whole.groupBy(*KEYS).agg(*totals, F.count("user").alias("users"))
    else:
        whole = whole.withColumn("users", F.hll_sketch_estimate("sketch"))
    return whole.select(*struct(DAILY_SCHEMA).names)


def read_parts(spark: SparkSession, parts: str, days: Iterable[str], users: str = "exact") -> DataFrame:
    """The parts of some days (folder names) that count: of each stream the newest compacted ones, and later batches."""
    folders = [f"{parts}/usage_date={d}" for d in days]
    stored = spark.read.schema(struct(parts_schema(users))).option("basePath", parts).parquet(*folders)
    through = stored.where("level = 1").groupBy(F.col("usage_date").alias("_day"), F.col("run").alias("_run")).agg(F.max("batch").alias("_through"))
    own = stored.join(through, F.col("usage_date").eqNullSafe(F.col("_day")) & (F.col("run") == F.col("_run")), "left")
    counts = F.col("_through").isNull() | (F.col("batch") > F.col("_through")) | ((F.col("level") == 1) & (F.col("batch") == F.col("_through")))
    return own.where(counts).drop("_day", "_run", "_through")


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def compact_parts(spark: SparkSession, parts: str, days: Iterable[str], users: str = "exact") -> None:
    """Puts one compacted part in place of all parts that a stream has of a day. Runs between batches."""
    loose = {}
    for day in days:
        for run in _children(spark, f"{parts}/usage_date={day}"):
            place = f"{parts}/usage_date={day}/{run}"
            if run.startswith("run=") and "level=0" in _children(spark, place):
                loose.setdefault(day, []).append(place)
    if not loose:
        return
    read = read_parts(spark, parts, loose, users)
    through = read.groupBy(F.col("usage_date").alias("_day"), F.col("run").alias("_run")).agg(F.max("batch").alias("batch"))
    whole = (
        _combined(read, users, "run")
        .join(through, F.col("usage_date").eqNullSafe(F.col("_day")) & (F.col("run") == F.col("_run")))
        .withColumn("level", F.lit(1)).select(*struct(parts_schema(users)).names)
    )
    staged = scratch_path(spark, "compacted-parts")
    whole.write.parquet(staged)
    written = spark.read.schema(struct(parts_schema(users))).parquet(staged)
    _write(written, parts, "usage_date", "run", "level", "batch")
    # what the compacted parts stand for is ignored already; the files go last
    newest = {(r.usage_date, r.run): r.batch for r in written.groupBy("usage_date", "run").agg(F.max("batch").alias("batch")).collect()}
    names = {(NO_DAY if d is None else str(d), f"run={run}"): batch for (d, run), batch in newest.items()}
    for day, places in loose.items():
        for place in places:
            through_batch = names[day, place.rsplit("/", 1)[1]]
            for level in (0, 1):
                for name in _children(spark, f"{place}/level={level}"):
                    number = int(name.split("=")[1]) if name.startswith("batch=") else None
                    if number is not None and (number <= through_batch if level == 0 else number < through_batch):
                        remove(spark, f"{place}/level={level}/{name}")
            if not _children(spark, f"{place}/level=0"):
                remove(spark, f"{place}/level=0")
    remove(spark, staged)


def _write(table: DataFrame, path: str, *partitions: str) -> None:
    (
        table.hint("rebalance", "usage_date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    )


def start_daily_usage(
    events: DataFrame, *, path: str, parts: str, checkpoint: str, users: str = "exact", closed_days: int | None = None, **trigger
) -> StreamingQuery:
    """Start the job: daily rows at ``path``, their parts at ``parts``.

    ``trigger`` is passed on (``availableNow=True``, ``processingTime='5 minutes'``). Both tables are partitioned by day, and a
    batch reads and writes the folders of the days it touched only. It writes its parts before the days, and both writes replace
    whole partitions: nothing is read from a place that is being written. With ``users='sketch'`` users are estimated (standard
    error 1.6 %) and a part is one row per day and service. With ``closed_days``, parts of days so much older than the newest one
    are compacted after each batch; a late event opens and closes its day again.
    """
    if users not in USERS:
        raise ValueError(f"users must be one of {', '.join(USERS)}")
    compacted: set[str] = set()

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # kept in the checkpoint
        staged = scratch_path(spark, "stream-parts")
        usage_parts(batch, users).write.parquet(staged)
        made = spark.read.parquet(staged)
        touched = [r.usage_date for r in made.select("usage_date").distinct().collect()]  # days of one batch
        if touched:
            placed = made.withColumns({"run": F.lit(run), "level": F.lit(0), "batch": F.lit(batch_id).cast("long")})
            _write(placed, parts, "usage_date", "run", "level", "batch")
            names = [NO_DAY if d is None else str(d) for d in touched]
            _write(daily_usage(read_parts(spark, parts, names, users), users), path, "usage_date")
            if closed_days is not None:
                compact(spark, [d for d in touched if d is not None])
        remove(spark, staged)

    def compact(spark: SparkSession, touched: list[date]) -> None:
        days = [n.split("=")[1] for n in _children(spark, parts) if n.startswith("usage_date=") and not n.endswith(NO_DAY)]
        if days:
            end = str(date.fromisoformat(max(days)) - timedelta(days=closed_days))
            compacted.difference_update(str(d) for d in touched)
            closed = [d for d in days if d < end and d not in compacted]
            compact_parts(spark, parts, closed, users)
            compacted.update(closed)

    return (
        events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
