import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stratapanel.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "stratapanel-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def month_ends(n, year=2020, month=1):
    out = []
    for i in range(n):
        y, m = divmod(year * 12 + month - 1 + i + 1, 12)
        out.append(dt.date(y, m + 1, 1) - dt.timedelta(days=1))
    return out


@pytest.fixture(scope="session")
def panel(spark):
    """Long panel from {ticker: [close or None, ...]} on month ends or given dates."""
    def build(columns, dates=None):
        n = len(next(iter(columns.values())))
        dates = dates or month_ends(n)
        rows = [(d, t, float(v)) for t, vs in columns.items() for d, v in zip(dates, vs) if v is not None]
        return spark.createDataFrame(rows, "date date, ticker string, close double")

    return build


@pytest.fixture(scope="session")
def returns(spark):
    def build(columns, dates=None):
        n = len(next(iter(columns.values())))
        dates = dates or month_ends(n)
        rows = [(s, d, float(v)) for s, vs in columns.items() for d, v in zip(dates, vs)]
        return spark.createDataFrame(rows, "strategy string, date date, ret double")

    return build
