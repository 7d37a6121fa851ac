import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)
os.environ["TZ"] = "UTC"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tarnlake.session import build_session, prepare

    session = build_session(4, shuffle_partitions=4, memory="3g")
    prepare(session)
    yield session
    session.stop()


@pytest.fixture
def small():
    return SMALL
