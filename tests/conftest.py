"""A small session for all tests."""

import pytest

from corpusflow.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="4", partitions=4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
