import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from clausewright.session import local_session

    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, memory="4g", partitions=4, **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()
