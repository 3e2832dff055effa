import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from creditlens.session import checkpoint_dir, local_session

    s = local_session(4, shuffle_partitions=8, app="creditlens-tests")
    checkpoint_dir(s)
    yield s


SF_SMALL = "/root/testdata/sf0.001"
