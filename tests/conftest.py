from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tests.model import FIELDS
from tracecairn.session import tune


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def trace(spark):
    """Build a raw trace DataFrame from dictionaries; missing fields stay null."""
    schema = ", ".join(f"{n} {t}" for n, t in FIELDS.items())

    def build(rows):
        return spark.createDataFrame([tuple(r.get(n) for n in FIELDS) for r in rows], schema)

    return build
