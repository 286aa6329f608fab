import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402,F401  (ships the package's functions to Python workers)
from millrace import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # tests bring no shared storage of their own
    scratch = tempfile.mkdtemp(prefix="millrace-")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": scratch, "spark.sql.warehouse.dir": f"{scratch}/warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
