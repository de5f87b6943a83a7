import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "2")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """apply(function of Columns, list of values or tuples): the function's value for each, through one-row DataFrames."""
    from pyspark.sql import functions as F

    def run(function, values, kinds=None):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        width = len(rows[0])
        schema = "i int, " + ", ".join(f"c{k} {(kinds or ['string'] * width)[k]}" for k in range(width))
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema).repartition(2)
        got = df.select("i", function(*(F.col(f"c{k}") for k in range(width))).alias("x")).collect()
        return [r.x for r in sorted(got, key=lambda r: r.i)]

    return run
