import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from canopy.session import get_session
    s = get_session("local[4]", 4, app="canopy-tests")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="canopy-test-ckpt-"))
    yield s


SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
