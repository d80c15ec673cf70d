import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from strata.session import build_session
    os.environ.setdefault("STRATA_SCRATCH", tempfile.mkdtemp(prefix="strata-tests-"))
    s = build_session("local[4]", app="strata-tests", shuffle_partitions=8)
    yield s
    s.stop()
