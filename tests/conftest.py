import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from marketlex.session import get_session, checkpoint_dir
    s = get_session("local[4]", "marketlex-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
