import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from statloom.session import get_session

# made before the test modules load, which build column expressions at import
SESSION = get_session("tests", 8, **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
