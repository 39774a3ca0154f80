import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shoplens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("shoplens-tests", "local[4]")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as tuples, optionally sorted."""
    def collect(df, *columns, ordered=False):
        found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return found if ordered else sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))

    return collect
