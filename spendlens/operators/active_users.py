"""Users active within the last days, for every day, without comparing days with days.

A user who is active on a day is active in the trailing windows of that day and of the next days. These intervals are united per
user; what is left are the days on which a user enters or leaves the window, and the number of active users is the running sum
of +1 and -1 over the days. Rows are user-days, then days; nothing grows with the width of a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALL = "All"


def active_users_sliding(
    usage: DataFrame, *, as_of: date, windows: Sequence[int] = (1, 7, 30), day: str = "usage_date", user: str = "user_name",
    service: str = "service_type", group_cols: Sequence[str] = (),
) -> DataFrame:
    """Distinct users of the last 1, 7 and 30 days per day and service, and over all services (``All``).

    Every day from the first use of a service to ``as_of`` is a row. Rows without a user or a day don't count.
    """
    keys = [*group_cols, service]
    active = (
        usage.where(F.col(user).isNotNull() & F.col(day).isNotNull() & (F.col(day) <= F.lit(as_of)))
        .select(*group_cols, F.explode(F.array(F.col(service), F.lit(ALL))).alias(service), F.col(user).alias("_user"), F.col(day).alias("_day"))
        .distinct()
    )
    whole = Window.partitionBy(*keys, "_user").orderBy("_day")
    spans = active.withColumns({"_before": F.lag("_day").over(whole), "_after": F.lead("_day").over(whole)}).select(
        *keys, "_day", "_before", "_after", F.explode(F.array(*map(F.lit, windows))).alias("_width")
    )
    # a user enters where the window before holds no day, and leaves a window's width after a day that no other follows in time
    enters = F.col("_before").isNull() | (F.datediff("_day", "_before") > F.col("_width"))
    leaves = F.col("_after").isNull() | (F.datediff("_after", "_day") > F.col("_width"))
    changes = spans.select(*keys, "_width", F.inline(F.array(
        F.struct(F.col("_day").alias("_at"), F.when(enters, 1).otherwise(0).alias("_change")),
        F.struct(F.date_add("_day", F.col("_width")).alias("_at"), F.when(leaves, -1).otherwise(0).alias("_change")),
    ))).where((F.col("_at") <= F.lit(as_of)))
    by_day = changes.groupBy(*keys, "_width", "_at").agg(F.sum("_change").alias("_change"))
    days = Window.partitionBy(*keys, "_width").orderBy("_at")
    running = by_day.select(
        *keys, "_width", "_at", F.sum("_change").over(days.rowsBetween(Window.unboundedPreceding, 0)).alias("_users"),
        F.coalesce(F.date_sub(F.lead("_at").over(days), 1), F.lit(as_of)).alias("_until"),
    )
    return (
        running.select(*keys, "_width", "_users", F.explode(F.sequence("_at", "_until")).alias(day))
        .groupBy(*keys, day)
        .agg(*[F.max(F.when(F.col("_width") == w, F.col("_users"))).alias(f"users_{w}d") for w in windows])
    )
