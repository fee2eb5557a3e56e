import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import build_session

    s = build_session("tests", cores="8")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def folder():
    return FOLDER
