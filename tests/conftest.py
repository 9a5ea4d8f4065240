import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clusterloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("clusterloom-tests", cpus=4, shuffle_partitions=8)
    yield s
