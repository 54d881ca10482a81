from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("BENCH_CPUS", "4")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillmill.session import local_session

    session = local_session("tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF
