import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seqlytics.session import RECOMMENDED, ROWS_PER_PIECE, ROWS_PER_PIECE_KEY  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    b = SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
    b = b.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    for k, v in RECOMMENDED.items():
        b = b.config(k, v)
    session = b.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=[ROWS_PER_PIECE, 20])
def both_ways(request, spark):
    """Run a test in one piece, and in pieces of few rows, so that most groups are cut."""
    spark.conf.set(ROWS_PER_PIECE_KEY, str(request.param))
    yield request.param
    spark.conf.unset(ROWS_PER_PIECE_KEY)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
