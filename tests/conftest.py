import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scriptorium.session import get_spark

    s = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "4",
                                 "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ckpt-test-")})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="scriptorium-test-")
