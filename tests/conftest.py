import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wordloom.session import local_session  # noqa: E402


def pytest_configure(config):
    config.addinivalue_line("markers", "oracle: every query against its oracle SQL (slow; run with -m oracle)")


def pytest_collection_modifyitems(config, items):
    if "oracle" not in (config.getoption("-m") or ""):
        for item in items:
            if "oracle" in item.keywords and item.get_closest_marker("oracle"):
                item.add_marker(pytest.mark.skip(reason="run with -m oracle"))


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    # keep several partitions although the test tables are tiny
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield session
    session.stop()


@pytest.fixture
def col(spark):
    """Value of one expression over one text."""
    from pyspark.sql import functions as F

    def run(expr, text):
        return spark.createDataFrame([(text,)], "text string").select(expr.alias("v")).first()["v"]

    return run
