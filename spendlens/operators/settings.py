"""Settings: defaults, merge of new defaults without touching stored values, typed lookup.

A settings table has one row per setting, or per account and setting when ``group_cols`` names the account.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import services as S
from ..functions.columns import structs, ts
from ..sources.upsert import upsert

COLUMNS = ["setting_name", "setting_value", "description", "data_type"]


def config_defaults(accounts: DataFrame, *, deployed_at: datetime | None = None) -> DataFrame:
    """The default settings for each row of ``accounts`` (a frame of key columns, possibly just one row); the deployment
    date is ``deployed_at``."""
    deployed = None if deployed_at is None else deployed_at.isoformat(sep=" ")
    rows = [(n, deployed if n == "DEPLOYMENT_DATE" else v, *rest) for n, v, *rest in S.DEFAULT_SETTINGS]
    table = structs(COLUMNS, rows, ["string"] * 4)
    return accounts.select("*", F.explode(table).alias("_s")).select(*accounts.columns, "_s.*")


def config_upsert(
    stored: DataFrame, defaults: DataFrame, *, run_ts: datetime, run_by: str, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Stored settings after a deployment: values stay, descriptions and types follow the defaults, new settings appear."""
    return upsert(
        stored, defaults, keys=[*group_cols, "setting_name"], update_cols=["description", "data_type"],
        insert_cols=[*group_cols, *COLUMNS], on_insert={"updated_at": ts(run_ts), "updated_by": F.lit(run_by)},
    )


def config_value(settings: DataFrame, name: str, *, group_cols: Sequence[str] = ()) -> DataFrame:
    return settings.where(F.col("setting_name") == name).select(*group_cols, "setting_value")


def typed_value(data_type: Column, value: Column) -> Column:
    """Number behind a setting's text; NULL for settings that are not numbers."""
    return F.when(data_type.isin("INTEGER", "DECIMAL"), value.try_cast("double"))


def config_typed(settings: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """Settings with their value in a column of its type; NULL in the other ones, and where the text is no such value."""
    def typed(name: str, kind: str) -> Column:
        return F.when(F.col("data_type") == name, F.col("setting_value").try_cast(kind))

    return settings.select(
        *group_cols, "setting_name", "data_type",
        typed("INTEGER", "long").alias("integer_value"), typed("DECIMAL", "decimal(38,12)").alias("decimal_value"),
        typed("BOOLEAN", "boolean").alias("boolean_value"), typed("TIMESTAMP", "timestamp_ntz").alias("timestamp_value"),
        F.when(F.col("data_type") == "STRING", F.col("setting_value")).alias("string_value"),
    )


def config_summary(settings: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    return settings.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("settings_count"), F.max("updated_at").alias("last_updated")
    )


def register_get_config(spark: SparkSession, overrides: DataFrame, *, name: str = "get_config", account: str = "account") -> str:
    """Registers the SQL function ``name(account, setting)``: the text that the account has stored, else the default, else NULL.

    The body is a subquery over ``overrides`` (account, setting_name, setting_value), which needs rows only for what an account has
    changed; the engine turns it into a join of the calling query. Returns the function's name.
    """
    view = f"{name}_stored"
    overrides.select(F.col(account).cast("string").alias("account"), "setting_name", "setting_value").createOrReplaceTempView(view)
    defaults = ", ".join(f"'{_quoted(n)}', '{_quoted(v)}'" for n, v, *_ in S.DEFAULT_SETTINGS if v is not None)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(of_account STRING, setting STRING) RETURNS STRING
        RETURN COALESCE((SELECT MAX(s.setting_value) FROM {view} s WHERE s.account = of_account AND s.setting_name = setting),
                        try_element_at(map({defaults}), setting))""")
    return name


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def configured_number(setting: str, *, account: str = "account", function: str = "get_config") -> Column:
    """A setting of a row's account as a number; the default where the stored text is no number."""
    default = next(float(v) for n, v, *_ in S.DEFAULT_SETTINGS if n == setting)
    return F.coalesce(F.expr(f"{function}(CAST({account} AS STRING), '{setting}')").try_cast("double"), F.lit(default))
