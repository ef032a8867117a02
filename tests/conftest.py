import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sievemark.session import session

    s = session("local[4]", 4, spark_driver_memory="2g", spark_sql_session_timeZone="UTC")
    s.sparkContext.setLogLevel("ERROR")
    return s
