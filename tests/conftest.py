import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tidepool.session import tune  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="tidepool-test-ckpt-")
    s = (SparkSession.builder.master("local[*]").appName("tidepool-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", ckpt)
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tidepool-test-wh-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    tune(s)
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
