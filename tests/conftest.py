import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quern.session import get_session, importable

    return importable(get_session("tests", 4, shuffle_partitions=4))
