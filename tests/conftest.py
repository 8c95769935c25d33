import pytest

from asoflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="8", memory="8g", partitions=4)
