import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from tessella.session import session

    s = session("local[4]", shuffle=4, spark__driver__memory="3g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def sf():
    if not (TESTDATA / "sf0.001").exists():
        pytest.skip("no test tables")
    return str(TESTDATA / "sf0.001")
