import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from harness import session

    return session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
