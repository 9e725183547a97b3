import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "6g")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Treat every key with more than ``rows`` rows as hot."""

    @contextmanager
    def limit(rows):
        spark.conf.set("tallyfold.rowsPerTask", str(rows))
        try:
            yield
        finally:
            spark.conf.unset("tallyfold.rowsPerTask")

    return limit
