import pytest

from weftline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, spark__sql__shuffle__partitions="4", spark__sql__codegen__wholeStage="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
