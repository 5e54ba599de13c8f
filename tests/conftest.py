import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from table_data import CRATE_DDL, CRATES  # noqa: E402
from tablewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8)
    yield s


@pytest.fixture
def crates(spark):
    return spark.createDataFrame(CRATES, CRATE_DDL)
