import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from siftara.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", shuffle_partitions=3)
    session.sparkContext.setLogLevel("ERROR")
    yield session
