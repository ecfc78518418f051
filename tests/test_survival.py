import random

from risegraph.operators import survival as S
from risegraph.params import Params

from .conftest import subs


def feats(spark, rows):
    return subs(spark, rows)


def test_fail_event_as_coded(spark):
    # solve P at 1500, later a failed row of P at 1560: an event for (u, P) as coded
    rows = [("u", 0, 1500.0, "P", 1000.0, "OK"), ("u", 1, 1520.0, "Q", 1000.0, "WA"),
            ("u", 2, 1560.0, "P", 1000.0, "WA")]
    pairs = {r.id_of_submission_task: r for r in S.survival_pairs(S.survival_rows(feats(spark, rows))).collect()}
    assert pairs["P"].event_observed == 1 and pairs["P"].time_to_event == 2


def test_other_problem_event_only_in_documented_measure(spark):
    # solve P at 1500, then Q at 1560: as coded no event for P; documented T8 observes it
    rows = [("u", 0, 1500.0, "P", 1000.0, "OK"), ("u", 1, 1560.0, "Q", 1000.0, "OK")]
    f = feats(spark, rows)
    pairs = {r.id_of_submission_task: r for r in S.survival_pairs(S.survival_rows(f)).collect()}
    assert pairs["P"].event_observed == 0
    tti = {r.id_of_submission_task: r for r in S.time_to_improve(f, levels=0).collect()}
    assert tti["P"].event_observed == 1 and tti["P"].time_to_improve == 1
    assert tti["Q"].event_observed == 0 and tti["Q"].duration == 0


def test_first_reaching_matches_brute_force(spark):
    rnd = random.Random(11)
    rows, qs, seqs = [], [], {}
    for h in "ab":
        r, seq = 1500, []
        for i in range(700):
            r += rnd.choice([-20, -5, 0, 5, 20])
            seq.append(r)
            rows.append((h, i, float(r)))
        seqs[h] = seq
        for q in range(40):
            s = rnd.randrange(700)
            qs.append((h, f"q{q}", s, float(seq[s] + rnd.choice([10, 60, 200, 900]))))
    R = spark.createDataFrame(rows, "handle string, idx long, rating_at_submission double")
    Q = spark.createDataFrame(qs, "handle string, qid string, start long, th double")
    got = {(r.handle, r.qid): r.event_idx for r in S.first_reaching(R, Q, block=3, levels=6).collect()}
    for h, q, s, th in qs:
        exp = next((j for j in range(s + 1, 700) if seqs[h][j] >= th), None)
        assert got.get((h, q)) == exp


def test_levels_for():
    assert S.levels_for(10, 1024) == 0 and S.levels_for(1024, 1024) == 1 and S.levels_for(5_000_000, 1024) == 2


def test_kaplan_meier_non_increasing_and_zero(spark):
    d = spark.createDataFrame([("P", t, e) for t, e in [(1, 1), (2, 0), (2, 1), (3, 1), (5, 0), (5, 1), (7, 1)]],
                              "id_of_submission_task string, time_to_event long, event_observed int")
    km = S.kaplan_meier(d).orderBy("time").collect()
    s = [r.survival for r in km]
    assert all(a >= b for a, b in zip(s, s[1:]))
    # hand computed: n = 7, 6, 4, 3, 1 at t = 1, 2, 3, 5, 7
    assert abs(s[0] - 6 / 7) < 1e-12 and abs(s[1] - 6 / 7 * 5 / 6) < 1e-12
    assert abs(s[2] - 6 / 7 * 5 / 6 * 3 / 4) < 1e-12 and abs(s[3] - s[2] * 2 / 3) < 1e-12
    assert s[4] == 0.0  # every subject still at risk has the event
    assert [r.at_risk for r in km] == [7, 6, 4, 3, 1]


def test_survival_effects_hazard(spark):
    rows = []
    for u in range(30):
        rows += [(f"u{u}", 0, 1500.0, "P", 1000.0, "OK"), (f"u{u}", 1, 1500.0 + 60 * (u % 2), "P", 1000.0, "WA")]
    f = feats(spark, rows)
    eff = S.survival_effects(S.survival_pairs(S.survival_rows(f)), Params()).collect()
    assert len(eff) == 1 and eff[0].event_rate == 0.5 and eff[0].hazard_ratio == 1.0
    assert eff[0].median_time_to_improve == 1.0 and eff[0].sample_size == 30


def test_too_few_levels_are_an_error(spark):
    import pytest
    rows = spark.createDataFrame([("u", i, float(i)) for i in range(10)], "handle string, idx long, rating_at_submission double")
    asked = spark.createDataFrame([("u", "q", 0, 9.0)], "handle string, qid string, start long, th double")
    assert S.first_reaching(rows, asked, block=3, levels=2).first()["event_idx"] == 9
    with pytest.raises(Exception, match="more levels are needed"):
        S.first_reaching(rows, asked, block=3, levels=1).collect()
