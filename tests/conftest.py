import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortfold.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        shuffle_partitions=8,
        extra={"spark.driver.memory": "4g", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="cf-wh-")},
    )
    yield session
    session.stop()
