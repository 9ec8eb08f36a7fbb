import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slicewise.session import local_session  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test tables")
    return TESTDATA


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def images(spark):
    def make(contents):
        data = [(name, bytearray(content)) for name, content in contents.items()]
        return spark.createDataFrame(data, "image string, data binary")

    return make
