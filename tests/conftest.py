import pytest

from bandlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    yield session
    session.stop()
