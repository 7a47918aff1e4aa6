import pytest

from mnemolake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
