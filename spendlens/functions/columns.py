"""Column expressions shared by the operators.

Money columns keep the type they arrive in. Telemetry declares them DECIMAL, so sums are exact and do not depend on
the order in which tasks finish or are retried; ratios are computed in DOUBLE from those exact sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime, timedelta
from string import Formatter

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: ColumnLike) -> Column:
    return col(c).cast("double")


def long_lit(value: int) -> Column:
    return F.lit(value).cast("long")


def ratio0(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """numerator / denominator, 0 where the denominator is not positive."""
    return F.when(col(denominator) > 0, dbl(numerator) / dbl(denominator)).otherwise(F.lit(0.0))


def ratio_null(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """numerator / denominator, NULL where the denominator is not positive."""
    return F.when(col(denominator) > 0, dbl(numerator) / dbl(denominator))


def per_million0(credits: ColumnLike, units: ColumnLike) -> Column:
    return F.when(col(units) > 0, dbl(credits) / dbl(units) * 1_000_000).otherwise(F.lit(0.0))


def per_million_null(credits: ColumnLike, units: ColumnLike) -> Column:
    return F.when(col(units) > 0, dbl(credits) / dbl(units) * 1_000_000)


def mean(c: ColumnLike) -> Column:
    """Average as exact sum over count; NULL for a group without values."""
    c = col(c)
    return F.when(F.count(c) > 0, F.sum(c).cast("double") / F.count(c))


def mean_over(c: ColumnLike, window: WindowSpec) -> Column:
    c = col(c)
    count = F.count(c).over(window)
    return F.when(count > 0, F.sum(c).over(window).cast("double") / count)


def pct_change(current: ColumnLike, previous: ColumnLike) -> Column:
    """Growth in percent; NULL when there is no baseline or the baseline is zero."""
    return F.when(col(previous) != 0, (dbl(current) - dbl(previous)) / dbl(previous) * 100)


def text_to_number(c: ColumnLike) -> Column:
    """Number held as text -> DECIMAL(38,0), NULL where it does not parse or has more digits; fractions are rounded.

    A failed cast costs an exception per row inside the engine, so text is only cast after a look at its form; plain
    integers of up to 18 digits are read as such.
    """
    c = col(c)
    number = c.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    return F.when(c.rlike(r"^[+-]?[0-9]{1,18}$"), c.try_cast("long").cast("decimal(38,0)")).when(
        number, c.try_cast("decimal(38,0)")
    )


def round_cents(c: ColumnLike, digits: int = 2) -> Column:
    """Half-up rounding through DECIMAL, so 0.125 is not at the mercy of its binary form."""
    return F.round(col(c).cast("decimal(38,6)"), digits).cast("double")


def whole_percent_text(c: ColumnLike) -> Column:
    return F.round(col(c), 0).cast("long").cast("string")


def ts(value: datetime) -> Column:
    """Timestamp literal without time zone (compares with NTZ columns without a cast of the column)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def filled_text(template: str, **values: Column) -> Column:
    """Text with {name} places filled from columns."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [values[name].cast("string")] if name else []
    return F.concat(*parts)


def day_before(as_of: datetime | date, days: int) -> date:
    start = as_of - timedelta(days=days)
    return start.date() if isinstance(start, datetime) else start


def as_date(as_of: datetime | date) -> date:
    return as_of.date() if isinstance(as_of, datetime) else as_of


def since(df: DataFrame, column: str, as_of: datetime, days: int) -> DataFrame:
    """Rows of the lookback window. The bound is a literal of the column's own type, so it is pushed to the scan."""
    if dict(df.dtypes)[column] == "date":
        return df.where(F.col(column) >= F.lit(day_before(as_of, days)))
    return df.where(F.col(column) >= ts(as_of - timedelta(days=days)))


def windowed(group_cols: Sequence[str], *order: Column) -> WindowSpec:
    """Window over already aggregated rows (days or services of a group), also for the one-group case."""
    return Window.partitionBy(*(group_cols or [F.lit(1)])).orderBy(*order)


def structs(names: Sequence[str], rows: Iterable[Sequence], types: Sequence[str]) -> Column:
    """Fixed small table as an array literal: explode() it next to each row instead of joining it."""
    return F.array(*[
        F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(names, row, types)]) for row in rows
    ])


def filled(columns: Sequence[str]) -> list[Column]:
    """Pivoted columns with 0 for missing cells."""
    return [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in columns]


OTHER, NONE = "(other)", "(none)"


def listed(c: ColumnLike, names: Sequence[str]) -> Column:
    """The name if it is listed, else whether there is one."""
    c = col(c)
    return F.when(c.isNull(), NONE).when(c.isin(list(names)), c).otherwise(OTHER)


def present(df: DataFrame) -> DataFrame:
    """Report form: DECIMAL becomes DOUBLE."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
