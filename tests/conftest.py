import pytest

from quire.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
