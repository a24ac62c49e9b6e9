import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textloom.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TEXTLOOM_DRIVER_MEMORY", "4g")
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
