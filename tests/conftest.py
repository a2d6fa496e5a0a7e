import pytest

from trackframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", "8g", partitions="3")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
