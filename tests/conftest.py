import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attesta.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[8]", 3, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
