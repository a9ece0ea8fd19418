import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    own = tempfile.mkdtemp(prefix="spark-")
    s = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
         .config("spark.local.dir", own).config("spark.sql.warehouse.dir", f"{own}/warehouse").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def col(spark):
    """Values of a Column function over rows of arguments."""
    def run(fn, rows, schema):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"_i int, {schema}")
        names = df.columns[1:]
        return [r.x for r in df.select("_i", fn(*[F.col(n) for n in names]).alias("x")).orderBy("_i").collect()]

    return run
