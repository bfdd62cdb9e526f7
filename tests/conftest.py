import os
import sys
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import local_session

    session = local_session("8", **{"spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture
def usage(spark):
    """Builds daily usage from (date offset in January 2025, service, users, operations, credits) rows."""

    def build(rows, extra=""):
        data = [(date(2025, 1, 1 + r[0]), *r[1:]) for r in rows]
        return spark.createDataFrame(
            data,
            "date DATE, service_type STRING, daily_unique_users BIGINT, total_operations BIGINT, total_credits DOUBLE" + extra,
        ).withColumn("total_credits", _decimal("total_credits"))

    return build


def _decimal(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("decimal(38,6)")
