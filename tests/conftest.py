import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tables import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from guardlake.spark import build_session
    session = build_session("guardlake-tests", "8")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from compare import views
    return views(SMALL)
