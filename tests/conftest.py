import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trialloom.session import get_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s
