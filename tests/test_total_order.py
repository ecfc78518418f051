"""Results don't depend on the layout of the input, though times tie."""

import pytest
from pyspark.sql import functions as F

from risegraph.functions.numeric import round_doubles
from risegraph.operators.placebo import random_problem_ids
from risegraph.params import SMALL, Params
from risegraph.plans.analysis import Analysis
from risegraph.sources.adapters import load_events_submissions

ARTEFACTS = ["features", "cem", "survival_pairs", "time_to_improve", "profiles", "transition_graph", "path_support",
             "improvement_points"]


@pytest.fixture(scope="module")
def layouts(spark):
    subs = load_events_submissions(spark, "/root/testdata/sf0.001")
    tied = subs.withColumn("time", F.floor(F.col("time") / 86_400_000_000) * 86_400_000_000)
    assert tied.groupBy("handle", "time").count().filter("count > 1").count() > 0
    plain = SMALL.with_(hot_user_rows=None)
    cut = SMALL.with_(hot_user_rows=40, segment_rows=45, index_partition_rows=70)
    return [Analysis(tied, plain), Analysis(tied.repartition(7, "verdict", "time"), plain),
            Analysis(tied.repartition(3, "id_of_submission_task"), cut)]


@pytest.mark.parametrize("name", ARTEFACTS)
def test_layouts_agree(layouts, name):
    first, *rest = [sorted(map(str, round_doubles(getattr(a, name), 9).collect())) for a in layouts]
    assert first and all(x == first for x in rest)


def test_default_order_names_every_column():
    assert set(Params().order_by) == {"time", "id_of_submission_task", "verdict", "rating_at_submission", "problem_rating"}


def test_random_labels_are_whole(spark):
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("handle"), F.col("id").alias("time"),
                                      F.lit("x").alias("id_of_submission_task"))
    labels = random_problem_ids(rows, F.lit(1000)).select("id_of_submission_task").distinct().count()
    assert labels == 1000
