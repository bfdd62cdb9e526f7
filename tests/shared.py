"""What the tests share. No conftest module: another folder's conftest would take its name."""

import os
from datetime import datetime

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
AS_OF = datetime(2025, 1, 31)


def rows(df):
    return [r.asDict() for r in df.collect()]


def one(df):
    found = rows(df)
    assert len(found) == 1, found
    return found[0]
