import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from risegraph.operators import matching as C
from risegraph.params import Params

BIN_COLS = "handle string, time long, id_of_submission_task string, verdict string, " \
           "rating_at_submission double, bin_rating int, bin_acc int, bin_diff int, " \
           "rating_gain_20 double, improved_20 int, roll_acc_20 double, roll_ok_diff_20 double"


def cem_frame(spark, rows):
    return spark.createDataFrame(rows, BIN_COLS)


def row(h, t, pid, gain, cell=(15, 5, 7), verdict="OK"):
    return (h, t, pid, verdict, 1500.0, *cell, float(gain), int(gain > 0), 0.5, 1400.0)


P = Params(min_samples=3, min_treated_prefilter=3)


def effects(spark, rows, params=P):
    return C.cem_effects(C.cem_cells(cem_frame(spark, rows), params), params)


def test_zero_variance(spark):
    # one constant-gain cell: uplift 0 and std_err 0 -> z and p are null, never significant
    rows = [row("a", i, "X", 30) for i in range(5)]
    sig = C.with_significance(C.att_effects(effects(spark, rows))).collect()[0]
    assert sig.att_score == 0.0 and sig.att_std_err == 0.0 and sig.z_score is None and sig.p_value is None
    assert C.significant(C.with_significance(C.att_effects(effects(spark, rows)))).count() == 0
    # constant treated gains in a mixed cell: treated_std 0, variance from the baseline only
    rows = [row("a", i, "X", 30) for i in range(5)] + [row("b", i, "Y", 10) for i in range(5)]
    e = {r.id_of_submission_task: r for r in effects(spark, rows).collect()}
    assert e["X"].treated_std == 0.0
    assert e["X"].bucket_variance == pytest.approx(e["X"].baseline_std ** 2 / 10)


def test_lone_state_below_minimum_is_dropped(spark):
    rows = [row("a", i, "X", 5 + i) for i in range(5)] + [row("b", i, "X", 1, cell=(20, 5, 7)) for i in range(2)]
    e = effects(spark, rows).collect()
    assert {(r.bin_rating, r.treated_count) for r in e} == {(15, 5)}


def test_weights_sum_to_one_and_match_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        cell = (rnd.choice([14, 15]), rnd.choice([4, 5]), 7)
        rows.append(row(f"u{i % 17}", i, rnd.choice("ABC"), rnd.randint(-60, 90), cell))
    e = effects(spark, rows)
    w = e.groupBy("id_of_submission_task").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-12 for r in w)
    # brute force baseline of one cell
    g = [r[8] for r in rows if r[5:8] == (15, 5, 7)]
    mean = sum(g) / len(g)
    sd = (sum((x - mean) ** 2 for x in g) / (len(g) - 1)) ** 0.5
    got = e.filter("bin_rating = 15 AND bin_acc = 5").select("baseline_gain", "baseline_std", "baseline_count").first()
    assert got.baseline_count == len(g)
    assert got.baseline_gain == pytest.approx(mean, abs=1e-9) and got.baseline_std == pytest.approx(sd, rel=1e-9)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("PQR"), st.sampled_from([(15, 5, 7), (16, 5, 7), (15, 6, 7)]),
                          st.integers(-300, 300)), min_size=1, max_size=60))
def test_merged_baseline_equals_direct_aggregate(spark, data):
    rows = [row(f"h{i}", i, p, g, c) for i, (p, c, g) in enumerate(data)]
    cem = cem_frame(spark, rows)
    merged = {tuple(r[:3]): r for r in C.cem_baseline(C.cem_cells(cem, P), Params(min_samples=1)).collect()}
    direct = cem.groupBy("bin_rating", "bin_acc", "bin_diff").agg(
        F.avg("rating_gain_20").alias("m"), F.stddev_samp("rating_gain_20").alias("s"),
        F.count("rating_gain_20").alias("n")).collect()
    for d in direct:
        m = merged[tuple(d[:3])]
        assert m.baseline_count == d.n and m.baseline_gain == pytest.approx(d.m, abs=1e-9)
        if d.s is None:
            assert m.baseline_std is None
        else:
            assert m.baseline_std == pytest.approx(d.s, abs=1e-7)


def test_null_bins_never_match(spark):
    rows = [row("a", i, "X", 5, cell=(15, None, 7)) for i in range(6)]
    assert effects(spark, rows).count() == 0


def test_cohort_examples_top_k_with_ties(spark):
    feats = spark.createDataFrame(
        [("u1", 1, "X", 1500.0, 1600.0, 100.0), ("u2", 2, "X", 1500.0, 1600.0, 100.0),
         ("u3", 3, "X", 1500.0, 1550.0, 50.0), ("u4", 4, "X", 1500.0, 1490.0, -10.0),
         ("u5", 5, "Y", 1500.0, 1700.0, 200.0)],
        "handle string, time long, id_of_submission_task string, rating_at_submission double, "
        "future_rating_20 double, rating_gain_20 double")
    sig = feats.sparkSession.createDataFrame([("X",)], "id_of_submission_task string")
    out = C.cohort_examples(feats, sig, Params(cohort_k=2)).collect()
    assert [(r.handle, r.rating_gain) for r in out] == [("u1", 100.0), ("u2", 100.0)]


def test_short_history_has_no_outcome(spark):
    # fewer than history + future + 1 rows: features exist, no future outcome, no effect rows
    from risegraph.operators.features import user_features
    from risegraph.operators.metadata import problem_metadata
    from .conftest import subs
    s = subs(spark, [("u", t, 1500.0 + t, "P", 1000.0, "OK") for t in range(40)])
    f = user_features(s, problem_metadata(s), Params())
    assert f.count() == 20
    assert C.cem_input(f, Params()).count() == 0


def test_solver_contrast_leave_one_out_reconstructs_totals(spark):
    rnd = random.Random(9)
    rows = [row(f"u{i % 7}", i, rnd.choice("AB"), rnd.randint(-50, 80), (15, 5, 7),
                rnd.choice(["OK", "WA"])) for i in range(300)]
    cem = cem_frame(spark, rows)
    out = {r.id_of_submission_task: r for r in C.att_effects_solvers(cem, P).collect()}
    for pid in "AB":
        t = [r[8] for r in rows if r[2] == pid and r[3] == "OK"]
        c = [r[8] for r in rows if not (r[2] == pid and r[3] == "OK")]
        assert len(t) + len(c) == len(rows)
        assert out[pid].att_score == pytest.approx(sum(t) / len(t) - sum(c) / len(c), abs=1e-9)
        assert out[pid].total_treated_samples == len(t)
