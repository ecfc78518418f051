import pytest

from risegraph.operators.features import user_features
from risegraph.operators.metadata import problem_metadata
from risegraph.params import Params

from .conftest import subs


def feats(spark, rows, params=Params()):
    s = subs(spark, rows)
    return user_features(s, problem_metadata(s, params), params).orderBy("time").collect()


def test_warmup_keeps_rows_after_full_window(spark):
    rows = [("u", t, 1500.0 + t, "P1", 1500.0, "OK" if t % 2 else "WA") for t in range(25)]
    out = feats(spark, rows)
    assert [r.time for r in out] == [20, 21, 22, 23, 24]
    first = out[0]
    assert first.roll_sub_cnt_20 == 20
    assert first.roll_acc_20 == 0.5 and first.roll_solve_cnt_20 == 10
    assert first.roll_rating_delta_20 == 1.0
    assert first.time_since_last_sub == 1


def test_no_leakage_own_verdict(spark):
    base = [("u", t, 1500.0, "P1", 1500.0, "OK") for t in range(30)]
    flipped = list(base)
    flipped[25] = ("u", 25, 1500.0, "P1", 1500.0, "WA")
    a = {r.time: r for r in feats(spark, base)}
    b = {r.time: r for r in feats(spark, flipped)}
    # the row itself does not see its own verdict; later rows do
    assert a[25].roll_acc_20 == b[25].roll_acc_20
    assert a[26].roll_acc_20 != b[26].roll_acc_20


def test_null_verdict_nulls_the_windows_covering_it(spark):
    rows = [("u", t, 1500.0, "P1", 1500.0, None if t == 10 else "OK") for t in range(45)]
    out = {r.time: r for r in feats(spark, rows)}
    assert out[30].roll_acc_20 is None and out[30].roll_solve_cnt_20 is None
    assert out[31].roll_acc_20 == 1.0  # frame 11..30 no longer touches row 10
    assert out[30].roll_ok_diff_20 == 0.0


def test_no_solves_gives_zero_difficulty(spark):
    rows = [("u", t, 1500.0, "P1", 1500.0, "WA") for t in range(45)]
    out = feats(spark, rows)
    assert all(r.roll_ok_diff_20 == 0.0 and r.roll_solve_cnt_20 == 0 for r in out)


def test_null_difficulty_counts_zero(spark):
    # Q has no provided rating and is never solved -> estimated difficulty null
    rows = [("u", t, 1500.0, "P" if t % 2 else "Q", 1000.0 if t % 2 else None,
             "OK" if t % 2 else "WA") for t in range(30)]
    s = subs(spark, rows)
    meta = {r.id_of_submission_task: r for r in problem_metadata(s).collect()}
    assert meta["Q"].estimated_difficulty is None
    assert meta["P"].estimated_difficulty == pytest.approx(0.7 * 1000 + 0.3 * 1500)
    out = feats(spark, rows)
    assert out[0].roll_ok_diff_20 == pytest.approx(meta["P"].estimated_difficulty)


def test_metadata_flags_and_clip(spark):
    rows = [("u", t, 3990.0, "HARD", 4500.0, "OK") for t in range(60)]
    rows += [("v", t, 1000.0, "NONE", None, None) for t in range(3)]
    meta = {r.id_of_submission_task: r for r in problem_metadata(subs(spark, rows)).collect()}
    assert meta["HARD"].estimated_difficulty == 4000.0  # clipped
    assert meta["HARD"].has_sufficient_support and meta["HARD"].stable_acceptance
    assert meta["NONE"].total_submissions == 0 and meta["NONE"].acceptance_rate == 0.0
    assert meta["NONE"].estimated_difficulty is None
