import pytest

from palaver.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "palaver-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
