import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("commitloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return SF_DIR


@pytest.fixture
def values(spark):
    """Evaluate a column expression over one input column; results in input order."""

    def run(inputs, kind, expression):
        from pyspark.sql import functions as F

        rows = [(i, value) for i, value in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        result = df.select("i", expression(F.col("x")).alias("y")).collect()
        return [row["y"] for row in sorted(result, key=lambda row: row["i"])]

    return run
