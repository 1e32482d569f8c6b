import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """3000 rows; one key, one value and one class hold a third of them."""
    return spark.range(3000).selectExpr(
        "id",
        "case when id % 3 = 0 then 'hot' else concat('k', id % 700) end as key",
        "case when id % 3 = 0 then 7.0D else (id * 37 % 1009) / 10.0D end as value",
        "case when id % 3 = 0 then 'A' when id % 7 = 1 then 'B' else 'C' end as label",
    )
