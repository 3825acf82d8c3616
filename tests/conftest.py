import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    import millrace.operators  # noqa: F401

    yield s
    s.stop()


@pytest.fixture
def large_plans(spark):
    """Make every input count as large, with blocks small enough to be crossed."""
    small = {"millrace.smallInputBytes": "0", "millrace.blockRows": "97", "millrace.knnChunk": "64"}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k in small:
        spark.conf.unset(k)


@pytest.fixture
def table(spark):
    """DataFrame from a dict of lists, through Arrow."""
    import pandas as pd

    return lambda ddl, **data: spark.createDataFrame(pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in data.items()}), ddl)
