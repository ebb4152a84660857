import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plurality.session import local_session  # noqa: E402

DATA = os.environ.get("PLURALITY_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests", spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-tests-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
