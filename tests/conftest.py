import pytest

from stationlake.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("4", partitions=4, spark__checkpoint__dir=shared)
    yield session
    session.stop()
