import os

import pytest

os.environ.setdefault("QUERN_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from quern.session import build_session

    s = build_session("tests", cpus=4, shuffle_partitions=4)
    yield s
    s.stop()
