import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablelens.plans.groups import DEFAULT_HOT_GROUP_ROWS, HOT_GROUP_ROWS
from tablelens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Set from how many rows on a group counts as hot, for one test."""

    def set_rows(rows):
        spark.conf.set(HOT_GROUP_ROWS, str(rows))

    yield set_rows
    spark.conf.set(HOT_GROUP_ROWS, str(DEFAULT_HOT_GROUP_ROWS))


@pytest.fixture(params=["whole groups", "cut groups"])
def either(request, hot):
    """Run a test twice: with plain windows and joins, and with every group cut."""
    hot(DEFAULT_HOT_GROUP_ROWS if request.param == "whole groups" else 2)


def rows(df):
    """The rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
