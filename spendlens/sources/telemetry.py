"""The usage tables an analysis runs on."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import since
from .schemas import SCHEMAS, TIME_COLUMN, struct


def _declared(table: DataFrame, name: str) -> DataFrame:
    """The declared columns in their declared types; a column of that type stays as it is, so filters reach the scan."""
    fields = struct(SCHEMAS[name]).fields
    return table.select(*[
        F.col(f.name) if table.schema[f.name].dataType == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name) for f in fields
    ])


class Telemetry:
    """Usage tables by name: analyst, search_daily, search_serving, functions, documents, documents_legacy, fine_tuning,
    metering, users and query_history (columns in ``schemas.SCHEMAS``).

    A table is given as a DataFrame or as a function that makes it, which is called when the table is first used.
    ``user_id`` is the key of ``users`` and ``query_id`` the key of ``query_history``.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown usage tables: {', '.join(sorted(unknown))}")
        self._tables = tables

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Telemetry:
        """One parquet folder per table below ``root``, read in the types it is stored in (money may be DOUBLE or any
        DECIMAL) and cast to the declared ones."""
        return cls(**{n: partial(lambda name: _declared(spark.read.parquet(f"{root}/{name}"), name), n) for n in SCHEMAS})

    @classmethod
    def from_tables(cls, spark: SparkSession, **table_names: str) -> Telemetry:
        """Catalog tables, by default named like the usage tables."""
        return cls(**{n: partial(lambda name: _declared(spark.table(table_names.get(name, name)), name), n) for n in SCHEMAS})

    def replace(self, **tables: DataFrame | Callable[[], DataFrame]) -> Telemetry:
        return Telemetry(**{**self._tables, **tables})

    def stored(self, root: str, *names: str) -> Telemetry:
        """The same tables, the named ones written below ``root``, once and now, and read from there: for tables that are made by
        joins and read by several jobs, each of which would make them anew."""
        for name in names:
            getattr(self, name).write.parquet(f"{root}/{name}")

        def read(name: str) -> DataFrame:
            made = getattr(self, name)
            return made.sparkSession.read.schema(made.schema).parquet(f"{root}/{name}")

        return self.replace(**{name: read(name) for name in names})

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("_tables", {})
        if name not in tables:
            raise AttributeError(name)
        if not isinstance(tables[name], DataFrame):
            tables[name] = tables[name]()
        return tables[name]

    def recent(self, name: str, as_of: datetime, lookback_days: int = 90) -> DataFrame:
        """Lookback scan of one usage table."""
        return since(getattr(self, name), TIME_COLUMN[name], as_of, lookback_days)
