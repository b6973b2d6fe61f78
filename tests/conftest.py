import pytest

from tests.sessions import session


@pytest.fixture(scope="session")
def spark():
    return session()
