import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from signalmart.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="sm-test-", dir="/tmp")


def rows(df, *cols):
    """Sorted list of tuples of the given columns."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
