"""Plan-shape guards for the scale properties the README claims."""
import contextlib
import io
import tempfile

import pytest

from risegraph.operators import matching
from risegraph.params import SMALL
from risegraph.plans.analysis import Analysis
from risegraph.sources.adapters import load_events_submissions


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def parquet_analysis(spark):
    d = tempfile.mkdtemp(prefix="risegraph-plans-")
    load_events_submissions(spark, "/root/testdata/sf0.001").write.parquet(f"{d}/subs")
    return Analysis(spark.read.parquet(f"{d}/subs"), SMALL)


def test_filter_pushdown_and_column_pruning(parquet_analysis):
    p = plan(parquet_analysis.profiles)
    assert "GreaterThanOrEqual(rating_at_submission,800.0)" in p
    assert "LessThanOrEqual(rating_at_submission,4000.0)" in p
    read = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    # the latest-state scan reads only what profiles need (no provided problem rating)
    assert read and all("verdict" in r or "problem_rating" not in r for r in read)


def test_features_and_outcome_share_one_exchange(parquet_analysis):
    p = plan(parquet_analysis.cem)
    assert p.count("hashpartitioning(handle") == 1


def test_top_k_uses_window_group_limit(parquet_analysis):
    assert "WindowGroupLimit" in plan(parquet_analysis.cohort_examples)


def test_recommendations_have_no_pair_explosion(parquet_analysis):
    p = plan(parquet_analysis.recommendations(False))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_the_outcome_window_runs_once(parquet_analysis):
    a = Analysis(parquet_analysis.submissions, SMALL)
    cells = plan(matching.cem_cells(a.cem, SMALL))
    assert cells.count("hashpartitioning(handle") == 1
    assert len([line for line in cells.splitlines() if line.startswith("Arguments: [lead(")]) == 1
    for df in (a.att_significance, a.baseline, a.treated, a.att_cohens_d, a.welch_stats):
        # they read the written cells only: no history is ordered again, nothing is cached
        p = plan(df)
        assert "hashpartitioning(handle" not in p and "lead(" not in p and "InMemoryTableScan" not in p


def test_placebos_read_their_rows_once(parquet_analysis):
    a = Analysis(parquet_analysis.submissions, SMALL)
    for df in (a.placebo_bias, a.pre_trend, a.random_placebo):
        p = plan(df)
        assert "hashpartitioning(handle" not in p and "lag(" not in p and "lead(" not in p


def test_recommendations_start_from_written_artefacts(parquet_analysis):
    a = Analysis(parquet_analysis.submissions, SMALL, materialize=True)
    p = plan(a.recommendations(False))
    assert "hashpartitioning(handle" not in p.split("InMemoryRelation")[0]
    assert p.count("Scan parquet") < 40


def test_time_to_improve_reads_narrow_rows(parquet_analysis):
    a = Analysis(parquet_analysis.submissions, SMALL)
    p = plan(a.time_to_improve)
    assert "lag(" not in p and "roll_acc" not in p
