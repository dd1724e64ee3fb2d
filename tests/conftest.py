import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from duelframe.session import checkpoint_dir, get_session
    s = get_session("local[*]", 8)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def fx(spark):
    import sports_fixture
    return sports_fixture.build(spark)
