import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepanel.plans.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", shuffle=4, app="tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Build a panel from {series: {iso date: value}} or rows."""

    def make(data):
        rows = [(s, dt.date.fromisoformat(d), None if v is None else float(v)) for s, cells in data.items() for d, v in cells.items()]
        return spark.createDataFrame(rows, "series string, ts date, value double")
    return make


def cells(df, *cols):
    """{(series, iso date): value} of a small result."""
    cols = cols or ("value",)
    out = {}
    for r in df.collect():
        v = tuple(r[c] for c in cols)
        out[(r["series"], str(r["ts"]))] = v[0] if len(v) == 1 else v
    return out
