"""Heavy-user segmentation must not change any result.

Every sf0.001 user has 50-80 rows; with hot_user_rows=40 and segment_rows=45
all of them are cut into two segments with halos, which exercises the
boundary handling of every segment-aware operator.
"""
import pytest
from pyspark.sql import functions as F

from risegraph.functions.numeric import round_doubles
from risegraph.functions.segments import IDX, SEG, index_hot_users
from risegraph.params import SMALL
from risegraph.plans.analysis import Analysis
from risegraph.sources.adapters import load_events_submissions

SF = "/root/testdata/sf0.001"
ARTEFACTS = ["features", "cem", "att_significance", "cohort_examples", "survival_rows", "survival_pairs",
             "survival_effects", "time_to_improve", "improvement_points", "placebo_bias", "pre_trend",
             "random_placebo", "profiles", "transition_graph", "path_support", "att_effects_solvers",
             "balance_check", "path_patterns", "kaplan_meier"]


@pytest.fixture(scope="module")
def pair(spark):
    plain = Analysis(load_events_submissions(spark, SF), SMALL.with_(hot_user_rows=None))
    seg = Analysis(load_events_submissions(spark, SF), SMALL.with_(hot_user_rows=40, segment_rows=45, index_partition_rows=70))
    return plain, seg


def rows(df):
    return sorted(tuple(r) for r in round_doubles(df, 9).collect())


@pytest.mark.parametrize("name", ARTEFACTS)
def test_segmented_equals_plain(pair, name):
    plain, seg = pair
    a, b = getattr(plain, name), getattr(seg, name)
    assert a.columns == b.columns
    assert rows(a) == rows(b)


def test_index_is_exact(spark):
    subs = load_events_submissions(spark, SF)
    idx = index_hot_users(subs, SMALL.with_(hot_user_rows=40, segment_rows=45, index_partition_rows=70))
    assert idx.filter(F.col(IDX).isNull()).count() == 0
    from pyspark.sql import Window
    rn = F.row_number().over(Window.partitionBy("handle").orderBy("time")) - 1
    bad = idx.withColumn("_rn", rn).filter((F.col("_rn") != F.col(IDX))
                                            | (F.col(SEG) != F.floor(F.col(IDX) / 45))).count()
    assert bad == 0


def test_recommendations_equal(pair):
    plain, seg = pair
    assert rows(plain.recommendations(False)) == rows(seg.recommendations(False))


def test_adapter_walk_segmented_equals_plain(spark):
    plain = load_events_submissions(spark, SF, SMALL.with_(hot_user_rows=None))
    seg = load_events_submissions(spark, SF, SMALL.with_(hot_user_rows=40, segment_rows=45, index_partition_rows=70))
    assert plain.columns == seg.columns
    assert rows(plain) == rows(seg)
