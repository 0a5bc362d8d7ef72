import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textloom.session import build_session

    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="2", spark__driver__memory="4g", spark__default__parallelism="4")
    yield session
    session.stop()
