import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quirelake.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest data folder, or a skip where it is not there."""
    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test data")
    return str(d)
