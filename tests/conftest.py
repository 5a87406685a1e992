from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    s = local_session(8, "6g", **{"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield s
    s.stop()


@pytest.fixture
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    return SF
