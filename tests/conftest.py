import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_lines(spark):
    """Numbered raw lines of one or more files, in any number of partitions."""

    def make(files: dict[str, list[str]], partitions: int = 4):
        rows = [
            (name, number, raw)
            for name, lines in files.items()
            for number, raw in enumerate(lines, 1)
        ]
        table = spark.createDataFrame(rows, "source_file string, line_no bigint, raw string")
        return table.repartition(partitions)

    return make
