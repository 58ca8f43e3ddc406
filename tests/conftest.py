import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pipeops.session import _GIVEN, build_session, release  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "pipeops-tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g", "spark.sql.warehouse.dir": "/tmp/pipeops-warehouse"},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="module", autouse=True)
def no_scratch_left():
    """What a module's queries left under the shared folder goes when it ends."""
    yield
    if _GIVEN:
        release(build_session("pipeops-tests"))


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
