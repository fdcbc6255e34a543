import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fieldweave.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session(cores=4, shuffle_partitions=4, memory="4g")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
