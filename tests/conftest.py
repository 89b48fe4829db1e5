import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from userprism.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "userprism-tests", shuffle_partitions=4, driver_memory="4g")
    yield session
    session.stop()


def by_key(df, key="user_id"):
    """Rows as dicts by key."""
    return {r[key]: r.asDict() for r in df.collect()}


def bag(df, *columns):
    """Rows as a sorted list of tuples."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)
