"""Propensity-score subclassification.

Where exact cells are too thin, rows are compared within strata of a fitted score of how likely a
row of that state belongs to the problem. The score of a problem is Fisher's linear discriminant
between its rows and the other rows of the cells in which it occurs (the common support), over the
three state bins: for normal covariates with one covariance it is the log odds of the propensity up
to a constant, and it has a closed form, so all problems are fitted in one aggregate over the
written (problem, cell) table. Each problem's cells are put in order of the score and cut into
``strata`` of about equal numbers of its rows; in a stratum its rows are the treated, all other rows
of the same cells the controls. No step reads a submission again, and no window holds more than a
problem's cells (some 7,600).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import merged, null_safe, var_samp, without
from ..functions.numeric import safe_div
from ..params import Params
from ..schema import BINS, PID
from ..session import materialize
from . import matching as C

#: Added to the variances, so that a covariate that doesn't vary has a finite weight.
RIDGE = 1e-6
PLACES = 9


def _matched(cells: DataFrame) -> DataFrame:
    """(problem, cell) rows with the moments of the gain of the problem's rows (t_) and of the
    cell's other rows (c_), where both have rows."""
    m = cells.filter(F.col("bin_rating").isNotNull() & F.col("bin_acc").isNotNull() & F.col("bin_diff").isNotNull()
                     & (F.col("treated_count") > 0))
    n = F.col("treated_count")
    own = m.select(PID, *BINS, n.alias("t_n"), F.col("treated_gain").alias("t_mean"),
                   F.coalesce((n - 1) * F.col("_var"), F.lit(0.0)).alias("t_m2"), F.col("treated_improve_prob").alias("t_p"))
    whole = own.select(*BINS, F.col("t_n").alias("a_n"), F.col("t_mean").alias("a_mean"), F.col("t_m2").alias("a_m2"),
                       F.col("t_n").alias("p_n"), F.col("t_p").alias("p_mean"), F.lit(0.0).alias("p_m2"))
    j = own.join(merged(whole, BINS, ["a", "p"]), BINS)
    c_n, c_mean, c_m2 = without(tuple(F.col(f"a_{x}") for x in ("n", "mean", "m2")), tuple(F.col(f"t_{x}") for x in ("n", "mean", "m2")))
    c_p = safe_div(F.col("p_n") * F.col("p_mean") - F.col("t_n") * F.col("t_p"), c_n)
    j = j.withColumns({"c_n": c_n, "c_mean": c_mean, "c_m2": c_m2, "c_p": c_p})
    return j.filter(F.col("c_n") > 0).select(PID, *BINS, *[f"{s}_{x}" for s in "tc" for x in ("n", "mean", "m2", "p")])


def _solved(s: dict[tuple[int, int], Column], d: list[Column]) -> list[Column]:
    """The solution of the symmetric 3 x 3 system by its adjugate."""
    a, b, c, e, f, g = s[0, 0], s[0, 1], s[0, 2], s[1, 1], s[1, 2], s[2, 2]
    adjugate = [[e * g - f * f, c * f - b * g, b * f - c * e],
                [c * f - b * g, a * g - c * c, b * c - a * f],
                [b * f - c * e, b * c - a * f, a * e - b * b]]
    det = a * adjugate[0][0] + b * adjugate[0][1] + c * adjugate[0][2]
    return [safe_div(sum((r * x for r, x in zip(row[1:], d[1:])), row[0] * d[0]), det) for row in adjugate]


def propensity_scores(matched: DataFrame) -> DataFrame:
    """``matched`` with ``score``, the discriminant of its problem."""
    x = [F.col(b).cast("double") for b in BINS]
    aggs = []
    for side in "tc":
        n = F.col(f"{side}_n")
        aggs.append(F.sum(n).alias(f"{side}"))
        aggs += [F.sum(n * v).alias(f"{side}{i}") for i, v in enumerate(x)]
        aggs += [F.sum(n * x[i] * x[k]).alias(f"{side}{i}{k}") for i in range(3) for k in range(i, 3)]
    fit = matched.groupBy(PID).agg(*aggs)
    # small integers: the sums are exact
    mean = {side: [F.col(f"{side}{i}") / F.col(side) for i in range(3)] for side in "tc"}
    within = {}
    for i in range(3):
        for k in range(i, 3):
            about = [F.col(f"{s}{i}{k}") - F.col(f"{s}{i}") * F.col(f"{s}{k}") / F.col(s) for s in "tc"]
            within[i, k] = (about[0] + about[1]) / F.greatest(F.col("t") + F.col("c") - 2, F.lit(1)) + F.lit(RIDGE if i == k else 0.0)
    weights = _solved(within, [mean["t"][i] - mean["c"][i] for i in range(3)])
    fit = fit.select(PID, *[w.alias(f"_w{i}") for i, w in enumerate(weights)])
    score = sum((F.col(f"_w{i}") * x[i] for i in range(1, 3)), F.col("_w0") * x[0])
    return matched.join(fit, PID).withColumn("score", F.round(score, PLACES)).drop("_w0", "_w1", "_w2")


def propensity_strata(cells: DataFrame, params: Params = Params(), strata: int = 5) -> DataFrame:
    """One row per (problem, stratum): treated and control rows, their mean gains, uplift and variance."""
    scored = materialize(propensity_scores(_matched(cells)), "table")
    w = Window.partitionBy(PID)
    upto = F.sum("t_n").over(w.orderBy("score", *BINS).rowsBetween(Window.unboundedPreceding, 0))
    middle = (upto - F.col("t_n") / 2) / F.sum("t_n").over(w)
    scored = scored.withColumn("stratum", F.least(F.lit(strata - 1), F.floor(F.lit(strata) * middle).cast("int")))
    keys = [PID, "stratum"]
    parts = scored.withColumnsRenamed({f"{s}_{x}": f"{s}g_{x}" for s in "tc" for x in ("n", "mean", "m2")})
    probs = scored.groupBy(*keys).agg(*[(F.sum(F.col(f"{s}_n") * F.col(f"{s}_p")) / F.sum(f"{s}_n")).alias(f"{s}_p") for s in "tc"],
                                      F.min("score").alias("low_score"), F.max("score").alias("high_score"))
    g = null_safe(merged(parts, keys, ["tg", "cg"]), probs, keys)
    return g.select(
        PID, "stratum", F.col("tg_n").alias("treated"), F.col("cg_n").alias("controls"), F.col("tg_mean").alias("treated_gain"),
        F.col("cg_mean").alias("control_gain"), (F.col("tg_mean") - F.col("cg_mean")).alias("uplift"),
        (var_samp(F.col("tg_n"), F.col("tg_m2")) / F.col("tg_n") + var_samp(F.col("cg_n"), F.col("cg_m2")) / F.col("cg_n")).alias("variance"),
        (F.col("t_p") - F.col("c_p")).alias("probability_uplift"), "low_score", "high_score")


def propensity_effects(strata: DataFrame, params: Params = Params()) -> DataFrame:
    """ATT per problem over its strata with at least ``min_samples`` rows on both sides, weighted by
    treated rows, with standard error, z and p."""
    s = strata.filter((F.col("treated") >= params.min_samples) & (F.col("controls") >= params.min_samples))
    n = F.col("treated")
    g = s.groupBy(PID).agg(
        (F.sum(n * F.col("uplift")) / F.sum(n)).alias("att_score"),
        (F.sum(n * n * F.col("variance")) / (F.sum(n) * F.sum(n))).alias("att_variance"),
        F.sum(n).alias("total_treated_samples"), F.count(F.lit(1)).alias("strata"),
        (F.sum(n * F.col("probability_uplift")) / F.sum(n)).alias("att_probability_uplift"))
    return C.with_significance(g)
