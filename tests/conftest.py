import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sparrowdex.runtime import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=4, partitions=4, memory="6g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    yield session
    session.stop()


@pytest.fixture
def small():
    if not Path(SMALL).exists():
        pytest.skip("no test tables here")
    return SMALL
