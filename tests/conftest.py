import pytest

from lawloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cpus="4", shuffle=4, memory="6g")
    yield s
    s.stop()
