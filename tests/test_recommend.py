from risegraph.operators import recommend as R
from risegraph.params import Params

CAT = "id_of_submission_task string, att_score double, att_probability_uplift double, p_value double, " \
      "total_treated_samples long, median_time_to_improve double, hazard_ratio double, " \
      "sequence_confidence double, estimated_difficulty double, final_score double"

# demo values (four of the twelve problems of the reference's seed)
DEMO = [("1462F", 61.2, 0.22, 0.0001, 450, 150.0, 1.8, 1500.0),
        ("1850H", 52.3, 0.18, 0.002, 260, 190.0, 1.5, 1900.0),
        ("1800E", 48.0, 0.17, 0.002, 320, 180.0, 1.5, 1800.0),
        ("1829G", 45.2, 0.16, 0.003, 290, 210.0, 1.4, 1800.0)]


def catalog(spark):
    rows = [(p, a, pr, pv, n, t, h, 0.0, d, a * pr * h) for p, a, pr, pv, n, t, h, d in DEMO]
    return spark.createDataFrame(rows, CAT)


def profiles(spark):
    return spark.createDataFrame([("candidate_master_1", 1920), ("pupil_user", 1250), ("tourist", 3995)],
                                 "handle string, current_rating int")


def test_golden_demo_case(spark):
    recs = R.recommendations(profiles(spark), catalog(spark), Params()).collect()
    cm = sorted([r for r in recs if r.handle == "candidate_master_1"], key=lambda r: r.rec_rank)
    assert [r.problem_id for r in cm] == ["1850H", "1800E", "1829G"]
    assert [round(r.final_score, 4) for r in cm] == [14.121, 12.24, 10.1248]
    tourist = sorted([r for r in recs if r.handle == "tourist"], key=lambda r: r.rec_rank)
    assert tourist[0].problem_id == "1462F" and round(tourist[0].final_score, 4) == 24.2352
    assert not tourist[0].in_band and all(r.status == "success" for r in recs)
    assert cm[0].explanation == ("Highly recommended (Score: 14.1). Causal Uplift: +52.3 points (p=0.0020). "
                                 "Solvers improve 1.5x faster.")


def test_no_match_status_on_empty_catalog(spark):
    empty = catalog(spark).limit(0)
    recs = R.recommendations(profiles(spark), empty, Params()).collect()
    assert {r.status for r in recs} == {"no_match"} and len(recs) == 3


def test_enrich_and_tiers(spark):
    recs = R.recommendations(profiles(spark), catalog(spark), Params())
    e = {(r.handle, r.problem_id): r for r in R.enrich(recs).collect()}
    r = e[("candidate_master_1", "1850H")]
    assert r.title == "Unknown Problem" and r.tags == [] and r.difficulty_tier == "hard"
    assert r.high_impact and r.confidence == "High" and (r.contest_id, r.problem_index) == ("1850", "H")
    tiers = {r.handle: r.rating_tier for r in R.user_tiers(profiles(spark)).collect()}
    assert tiers == {"candidate_master_1": "candidate", "pupil_user": "pupil", "tourist": "legendary"}


def test_band_is_inclusive(spark):
    cat = catalog(spark)
    prof = spark.createDataFrame([("x", 1700), ("y", 2100)], "handle string, current_rating int")
    recs = R.recommendations(prof, cat, Params()).collect()
    assert {r.problem_id for r in recs if r.handle == "x"} == {"1462F", "1850H", "1800E", "1829G"}
    assert {r.problem_id for r in recs if r.handle == "y"} == {"1850H"}
