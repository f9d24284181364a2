import os

import pytest

from tracewell.session import get_spark

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[8]", spark__driver__memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
