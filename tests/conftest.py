import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from plateworks.runtime import session

    os.environ.setdefault("PLATEWORKS_DRIVER_MEMORY", "4g")
    s = session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df):
    """The rows of a result, sorted by their text."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
