import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import get_session
    s = get_session("tests", "local[4]", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture
def small_tasks(spark):
    """A row limit so low that hot keys take the sliced path."""
    from tidemark.session import MAX_ROWS_KEY
    spark.conf.set(MAX_ROWS_KEY, "60")
    yield 60
    spark.conf.unset(MAX_ROWS_KEY)
