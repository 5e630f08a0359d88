import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from goldrec.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4)
    yield session
    session.stop()


@pytest.fixture
def hot_limit(spark):
    """Make keys with more than a few rows hot."""

    def set_limit(rows: int):
        spark.conf.set("goldrec.hot.rows", str(rows))

    yield set_limit
    spark.conf.unset("goldrec.hot.rows")
