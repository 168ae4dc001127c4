import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from wardledger.session import TUNING  # noqa: E402
from wardledger.sources.schemas import SCHEMAS  # noqa: E402
from wardledger.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    )
    for key, value in TUNING.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """A small declared table from dicts; missing columns are NULL."""

    def make(name, *rows):
        schema = SCHEMAS[name]
        return spark.createDataFrame([[r.get(f.name) for f in schema.fields] for r in rows], schema)

    return make


@pytest.fixture
def tables(table):
    """Tables of which the given ones hold rows and the others are empty."""

    def make(**rows):
        return Tables(lambda name: table(name, *rows.get(name, [])))

    return make
