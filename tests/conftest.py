import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pitspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "pitspark-tests")
    yield session
    session.stop()


@pytest.fixture()
def ts():
    from datetime import datetime

    return lambda text: datetime.fromisoformat(text)
