import pytest

from lorekeep.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", partitions=4, app="tests")
    yield session
    session.stop()
