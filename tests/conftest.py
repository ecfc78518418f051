import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("risegraph-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.driver.memory", "6g")
         .config("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
         .config("spark.sql.maxPlanStringLength", str(4 * 1024 * 1024))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="risegraph-test-ckpt-"))
    yield s


SUB_SCHEMA = ("handle string, time long, rating_at_submission double, id_of_submission_task string, "
              "problem_rating double, verdict string")


def subs(spark, rows):
    """rows: (handle, time, rating, problem, problem_rating, verdict)."""
    return spark.createDataFrame(rows, SUB_SCHEMA)
