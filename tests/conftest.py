import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lurus.plans.session import importable, local_session

    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    importable(session)
    return session


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    from tests.compare import connect

    return connect(sf_dir)
