import pytest

from tests.compare import session
from vaultferry.session import prepare_session


@pytest.fixture(scope="session")
def spark():
    active = prepare_session(session())
    active.sparkContext.setLogLevel("ERROR")
    yield active
    active.stop()
