import os
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from gridquarry.sources.session import session

    return session(cores=os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4)
