import pytest

from runloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
