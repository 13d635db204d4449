import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.operators.hotkeys import HOT_ROWS_CONF, HOT_TASKS_CONF  # noqa: E402
from riskloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "8g")
    session.conf.set(HOT_TASKS_CONF, "1")  # with eight partitions a third of the rows is less than three tasks
    yield session
    session.stop()


@pytest.fixture
def sf():
    return SF


@pytest.fixture
def small_hot(spark):
    """Keys count as hot from five rows on."""
    spark.conf.set(HOT_ROWS_CONF, "5")
    yield
    spark.conf.unset(HOT_ROWS_CONF)


@pytest.fixture
def no_hot(spark):
    spark.conf.set(HOT_ROWS_CONF, str(10**12))
    yield
    spark.conf.unset(HOT_ROWS_CONF)
