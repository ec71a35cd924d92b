import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from foreshock.functions.reuse import release  # noqa: E402
from foreshock.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _release():
    yield
    release()
