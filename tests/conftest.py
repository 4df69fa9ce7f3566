"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from provena import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session.build("local[4]", shuffle_partitions=4, app="tests")
    yield built
    built.stop()
