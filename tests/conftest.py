import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidemill.runtime import session

    out = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__autoBroadcastJoinThreshold="10m",
    )
    out.sparkContext.setLogLevel("ERROR")
    from tidemill.runtime import ship

    ship(out)
    yield out
    out.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
