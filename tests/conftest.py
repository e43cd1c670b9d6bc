import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import local_session

    return local_session("4", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
