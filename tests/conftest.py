from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import SparkSession

from tallyspark.session import configure


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tally-test-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)
