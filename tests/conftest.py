import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from echolex.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """One column of strings as a table (id, c)."""
    return lambda xs: spark.createDataFrame(list(enumerate(xs)), "id int, c string")


@pytest.fixture
def compute(values):
    """A Column function applied to each string of a list."""

    def run(function, xs):
        rows = values(xs).select("id", function("c").alias("out")).collect()
        return [r["out"] for r in sorted(rows, key=lambda r: r["id"])]

    return run
