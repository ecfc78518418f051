"""Column names and Spark schemas of the submissions log and its artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed column names of the submissions log
HANDLE = "handle"
TIME = "time"
RATING = "rating_at_submission"
PID = "id_of_submission_task"
PROBLEM_RATING = "problem_rating"
VERDICT = "verdict"
OK = "OK"

BINS = ["bin_rating", "bin_acc", "bin_diff"]

SUBMISSIONS = T.StructType(
    [
        T.StructField(HANDLE, T.StringType()),
        T.StructField(TIME, T.LongType()),
        T.StructField(RATING, T.DoubleType()),
        T.StructField(PID, T.StringType()),
        T.StructField(PROBLEM_RATING, T.DoubleType()),
        T.StructField(VERDICT, T.StringType()),
    ]
)

REQUIRED_SUBMISSION_COLUMNS = (HANDLE, TIME, RATING, PID, VERDICT)


REQUIRED_METADATA_COLUMNS = (
    "estimated_difficulty",
    "acceptance_rate",
    "has_sufficient_support",
    "stable_acceptance",
)


def require_columns(df: DataFrame, columns, what: str = "dataset") -> DataFrame:
    """Raise a clear error when ``df`` lacks any of ``columns``."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns in {what}: {missing}")
    return df
