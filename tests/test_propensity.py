"""The discriminant score and its strata against direct computation."""
import random

import numpy as np
import pytest

from risegraph.operators import matching as C
from risegraph.operators import propensity as X
from risegraph.params import Params

from .test_moments_quantiles import COLUMNS


def rows(effect, n=3000):
    """Rows of problem A are more likely at high ratings, where gains are higher anyway."""
    rnd = random.Random(5)
    out = []
    for i in range(n):
        b = rnd.randint(10, 20)
        pid = "A" if rnd.random() < (b - 9) / 14 else rnd.choice("BC")
        gain = 5.0 * b + rnd.randint(-8, 8) + (effect if pid == "A" else 0)
        out.append((f"u{i % 7}", i, pid, "OK", 100.0 * b, b, rnd.randint(3, 6), 7, gain, int(gain > 80), 0.5, 1400.0))
    return out


def test_strata_remove_the_confounding(spark):
    data = rows(12.0)
    params = Params(min_samples=5, min_treated_prefilter=5)
    strata = X.propensity_strata(C.cem_cells(spark.createDataFrame(data, COLUMNS), params), params)
    got = {r[0]: r for r in X.propensity_effects(strata, params).collect()}["A"]
    naive = np.mean([r[8] for r in data if r[2] == "A"]) - np.mean([r[8] for r in data if r[2] != "A"])
    assert naive > 18 and abs(got.att_score - 12) < 3 < naive - 12
    assert got.p_value < 1e-6 and got.strata == 5


def test_scores_and_strata_directly(spark):
    data = rows(0.0, 600)
    params = Params(min_samples=2, min_treated_prefilter=2)
    cells = C.cem_cells(spark.createDataFrame(data, COLUMNS), params)
    scored = {tuple(r[:4]): r.score for r in X.propensity_scores(X._matched(cells)).select(
        "id_of_submission_task", "bin_rating", "bin_acc", "bin_diff", "score").collect()}
    for pid in "ABC":
        at = {(r[5], r[6], r[7]) for r in data if r[2] == pid} & {(r[5], r[6], r[7]) for r in data if r[2] != pid}
        t = np.array([r[5:8] for r in data if r[2] == pid and r[5:8] in at], float)
        c = np.array([r[5:8] for r in data if r[2] != pid and r[5:8] in at], float)
        pooled = ((t - t.mean(0)).T @ (t - t.mean(0)) + (c - c.mean(0)).T @ (c - c.mean(0))) / (len(t) + len(c) - 2)
        w = np.linalg.solve(pooled + X.RIDGE * np.eye(3), t.mean(0) - c.mean(0))
        assert {k[1:] for k in scored if k[0] == pid} == at
        for cell in at:
            assert scored[(pid, *cell)] == pytest.approx(float(w @ np.array(cell, float)), abs=1e-6)
    strata = X.propensity_strata(cells, params).collect()
    for r in strata:
        inside = {k[1:] for k, s in scored.items() if k[0] == r[0] and r.low_score <= s <= r.high_score}
        treated = [x for x in data if x[2] == r[0] and x[5:8] in inside]
        assert r.treated <= len(treated) and r.controls > 0
    for pid in "ABC":
        assert sum(r.treated for r in strata if r[0] == pid) == sum(
            1 for x in data if x[2] == pid and (pid, *x[5:8]) in scored)


def test_no_rows(spark):
    cells = C.cem_cells(spark.createDataFrame([], COLUMNS))
    assert X.propensity_effects(X.propensity_strata(cells)).collect() == []
