import pytest
from pyspark.sql import SparkSession

from tallymark.session import configure


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g"))
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
