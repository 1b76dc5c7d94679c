import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracegraph.session import local_session, prepare, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session(8, "tests"))
    yield session
    release(session)
