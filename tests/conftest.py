import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flowwarden.session import get_spark
    s = get_spark("local[4]", app="flowwarden-tests", shuffle_partitions=4)
    yield s
    s.stop()
