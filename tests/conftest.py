import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from martwright.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, "4g", **{"spark.checkpoint.dir": str(folder)})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Star schema of the smallest data folder."""
    from __spark_entry__ import warehouse

    return warehouse(spark, SMALL)


def plan_of(frame) -> str:
    """Physical plan as text."""
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plan():
    return plan_of
