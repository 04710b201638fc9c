import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lanternfish.session import get_session

    session = get_session("local[4]", 4, **{"spark.driver.memory": "2g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
