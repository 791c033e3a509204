import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from scorekit.session import get_spark, release_intermediates
    wh = tempfile.mkdtemp(prefix="scorekit-wh-")
    s = get_spark("scorekit-tests", master="local[*]", shuffle_partitions=8,
                  extra={"spark.sql.warehouse.dir": wh, "spark.driver.memory": "8g",
                         "spark.checkpoint.dir": tempfile.mkdtemp(prefix="scorekit-ckpt-")})
    yield s
    release_intermediates(s)
    s.stop()
