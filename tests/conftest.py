from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from oracle import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from casewise.session import local_session

    session = local_session(cores=8, app="casewise-tests", memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
