import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from estatelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scan(spark):
    """Scans literal M texts; returns one list of call rows per text."""
    from estatelens.operators import calls

    def run(*texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, expression string")
        found = [[] for _ in texts]
        for row in calls.scan_expressions(df).orderBy("id", "call_pos").collect():
            found[row.id].append(row)
        return found

    return run
