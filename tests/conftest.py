import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sqlforge.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from checks.compare import duck_connect
    return duck_connect(SF_SMALL)
