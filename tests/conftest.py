import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from lodestrata.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(4, shuffle=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
