"""Exact ranks and quantiles of groups too large for one task.

Ranks cut the rows into ranges of about equal size; quantiles cut a group into value bands (1/256 of an e-fold wide). The
sizes of ranges and bands are small aggregates, so their running totals are cheap; only rows of one ever meet in a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .columns import col, dbl

BANDS_PER_EFOLD = 256
_BAND_ZERO = 400_000  # above |ln(smallest double)| * BANDS_PER_EFOLD, keeps bands of positive values positive


def band(value: Column | str) -> Column:
    """Band number, non-decreasing in the value; negative values mirror positive ones.

    Never NULL: otherwise joins on the band would add a filter to one of two equal subplans, which then run twice.
    """
    v = dbl(value)

    def level(x: Column) -> Column:
        return F.floor(F.ln(x) * BANDS_PER_EFOLD) + _BAND_ZERO

    zero = F.lit(0).cast("long")
    return F.coalesce(F.when(v > 0, level(v)).when(v < 0, -level(-v)), zero)


def rank_rows(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    rank_col: str = "rank",
    block_rows: int = 1 << 20,
) -> DataFrame:
    """Number the rows of every group 1..n by descending value. Group and value columns must not be NULL.

    Ties are ordered by the md5 of the remaining columns, then by these. Fully equal rows travel as one row with a count (in
    blocks of ``block_rows``) and are expanded last. The rows are cut into ranges of about equal size along that order,
    whatever the values are, and written with the number of their range to the shared folder; a rank is the rows of the
    group's earlier ranges plus the place in its own. Where the cuts lie comes from a sample and changes no rank.
    """
    columns = df.columns
    ties = [c for c in columns if c not in group_cols and c != value_col]
    tie_text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ties])
    order = [F.desc(value_col), F.col("_tie"), *[F.col(c).asc_nulls_first() for c in ties], F.col("_block")]
    copies = (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_tie", F.md5(tie_text.cast("binary")))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {block_rows}"))))
        .withColumn("_n", F.least(F.lit(block_rows), F.col("_copies") - F.col("_block") * block_rows))
        .drop("_copies")
    )
    path = scratch_path(df.sparkSession, "ranked-ranges")
    copies.repartitionByRange(*[F.col(c) for c in group_cols], *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.schema(copies.withColumn("_range", F.lit(0)).schema).parquet(path)

    def earlier(*partition: str):
        return Window.partitionBy(*partition).rowsBetween(Window.unboundedPreceding, -1)

    ranges = ranged.groupBy(*group_cols, "_range").agg(F.sum("_n").alias("_rows"))
    before = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier(*group_cols).orderBy("_range")), F.lit(0)))
    return (
        ranged.join(before.drop("_rows"), [*group_cols, "_range"])
        .withColumn(
            "_start", F.col("_before") + F.coalesce(F.sum("_n").over(earlier(*group_cols, "_range").orderBy(*order)), F.lit(0)))
        .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .select(*columns, (F.col("_start") + F.col("_i")).alias(rank_col))
    )


def exact_quantiles(
    df: DataFrame, group_cols: Sequence[str], value_col: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group. ``quantiles`` maps output names to probabilities.

    Equal values travel as one row with a count, and only the bands that hold a wanted position are sorted.
    """
    counts = (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*group_cols, dbl(value_col).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_band", band("_value"))
    )
    in_group = Window.partitionBy(*group_cols)
    bands = (
        counts.groupBy(*group_cols, "_band")
        .agg(F.sum("_n").alias("_rows"))
        .withColumn(
            "_below",
            F.coalesce(
                F.sum("_rows").over(in_group.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("_total", F.sum("_rows").over(in_group))
    )

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    wanted = F.array(*[
        F.struct(F.lit(f"{name}:{side}").alias("name"), side_fn(position(p)).cast("long").alias("k"))
        for name, p in quantiles.items()
        for side, side_fn in (("lo", F.floor), ("hi", F.ceil))
    ])
    holding = bands.withColumn(
        "_wanted",
        F.filter(wanted, lambda w: (w["k"] >= F.col("_below")) & (w["k"] < F.col("_below") + F.col("_rows"))),
    ).where(F.size("_wanted") > 0)

    in_band = Window.partitionBy(*group_cols, "_band").orderBy("_value")
    picked = (
        counts.join(holding.drop("_rows"), [*group_cols, "_band"])
        .withColumn("_end", F.col("_below") + F.sum("_n").over(in_band.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(
            "_hit",
            F.explode(
                F.filter("_wanted", lambda w: (w["k"] >= F.col("_end") - F.col("_n")) & (w["k"] < F.col("_end")))
            ),
        )
    )
    values = picked.groupBy(*group_cols).agg(
        F.max("_total").alias("_total"),
        *[
            F.max(F.when(F.col("_hit.name") == f"{name}:{side}", F.col("_value"))).alias(f"_{name}_{side}")
            for name in quantiles
            for side in ("lo", "hi")
        ],
    )

    def between(name: str, p: float) -> Column:
        share = position(p) - F.floor(position(p))
        return col(f"_{name}_lo") + (col(f"_{name}_hi") - col(f"_{name}_lo")) * share

    return values.select(*group_cols, *[between(name, p).alias(name) for name, p in quantiles.items()])
