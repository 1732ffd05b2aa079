import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from cuewright.session import build_session

    session = build_session("tests", 4, **{"spark__sql__shuffle__partitions": "4", "spark__sql__execution__pyspark__udf__faulthandler__enabled": "true"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
