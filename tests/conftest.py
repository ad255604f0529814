import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from crawlops.fixtures import Tables  # noqa: E402
from crawlops.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


def rows(df, *cols):
    """Rows of a small result as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*(cols or sorted(df.columns))).collect()), key=repr)
