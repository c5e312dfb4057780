import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabulark import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
    s.sparkContext.setLogLevel("ERROR")
    return s
