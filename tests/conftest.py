import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(__file__)), os.path.dirname(__file__)]

from harness import SF_DIR  # noqa: E402
from sheetwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sheets(spark):
    from sheetwise.plans.fixtures import tables

    return tables(spark, SF_DIR)
