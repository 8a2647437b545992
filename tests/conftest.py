"""One local session for all tests."""

import pytest

from brinewell.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "12g", 8, "brinewell-tests", f"file://{tmp_path_factory.mktemp('shared')}")
    yield s
    s.stop()
