import pytest
from shared import one, rows
from pyspark.sql import functions as F

from spendlens.functions import columns as C


def value(spark, expression, **data):
    df = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, (v, t) in data.items()])
    return df.select(expression.alias("x")).first().x


def test_ratios_guard_the_denominator(spark):
    for d in (0, -1, None):
        assert value(spark, C.ratio0("n", "d"), n=(5, "int"), d=(d, "int")) == 0.0
        assert value(spark, C.ratio_null("n", "d"), n=(5, "int"), d=(d, "int")) is None
    assert value(spark, C.ratio0("n", "d"), n=(5, "int"), d=(2, "int")) == 2.5
    assert value(spark, C.per_million0("n", "d"), n=(3, "int"), d=(1500, "int")) == 2000.0
    assert value(spark, C.per_million_null("n", "d"), n=(3, "int"), d=(0, "int")) is None


@pytest.mark.parametrize("text, number", [
    ("12", 12), (" 12 ", 12), ("-3", -3), ("1.5", 2), ("1e3", 1000), ("x", None), ("n/a", None), ("", None), (None, None),
    ("99999999999999999999", 99999999999999999999), ("9223372036854775808", 9223372036854775808), ("9" * 38, 10**38 - 1), ("9" * 39, None), ("+7", 7), (".4", 0),
])
def test_text_to_number(spark, text, number):
    assert value(spark, C.text_to_number("t"), t=(text, "string")) == number


def test_growth_of_100_over_80(spark):
    assert value(spark, C.pct_change("a", "b"), a=(100, "int"), b=(80, "int")) == 25.0
    assert value(spark, C.pct_change("a", "b"), a=(100, "int"), b=(0, "int")) is None
    assert value(spark, C.pct_change("a", "b"), a=(100, "int"), b=(None, "int")) is None


def test_mean_ignores_nulls_and_is_null_without_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 4), ("b", None)], "g STRING, v BIGINT")
    got = {r["g"]: r["m"] for r in rows(df.groupBy("g").agg(C.mean("v").alias("m")))}
    assert got == {"a": 2.5, "b": None}


def test_rounding_is_half_up(spark):
    assert value(spark, C.round_cents("v"), v=(0.125, "double")) == 0.13
    assert value(spark, C.round_cents("v"), v=(2.675, "double")) == 2.68


def test_present_turns_decimals_into_doubles(spark):
    df = spark.sql("SELECT CAST(1.5 AS DECIMAL(10,2)) AS a, 2 AS `b.c`, 'x' AS s")
    got = C.present(df)
    assert dict(got.dtypes) == {"a": "double", "b.c": "int", "s": "string"}
    assert one(got)["a"] == 1.5
