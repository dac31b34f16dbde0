import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from streetloom.session import local_session, ship_package
    s = local_session(cores=8)
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def duck():
    from tests.oracle import connect
    return connect(SMALL)


SMALL = "/root/testdata/sf0.001"
