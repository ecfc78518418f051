"""Matched-cohort uplift by coarsened exact matching (C1-C12) and its
statistics (X2 Bonferroni, X3 Cohen's d, X4 Welch, X5 balance, X8 solvers
versus everyone else, X13 intervals).

Plan shape: one exchange on ``handle`` for the outcome window (shared with the
features), one partial aggregation of the rows into (problem, state cell)
moments, written once (``written_cells``). Everything else reads that small table:
the baseline of a cell is an aggregate of its moments joined back (a
parallel-variance merge), the weights a window over the problem, the ATT a
group-by on the same partitioning. No consumer runs the outcome window again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import merged, moments, null_safe, var_samp, without
from ..functions.numeric import normal_two_sided_p, safe_div, state_bin, student_two_sided_p, z_score
from ..functions.segments import strip
from ..functions.sequence import feature_names, outcome_names, user_window
from ..params import Params
from ..schema import BINS, HANDLE, OK, PID, RATING, VERDICT
from ..session import materialize


def with_outcome(features: DataFrame, params: Params = Params(), drop_missing: bool = True) -> DataFrame:
    """Rating ``future`` rows later, the gain and an improved flag."""
    on = outcome_names(params)
    df = features.withColumn(on["future"], F.lead(RATING, params.future).over(user_window(params, df=features)))
    df = df.withColumns({on["gain"]: F.col(on["future"]) - F.col(RATING)})
    df = df.withColumn(on["improved"], (F.col(on["gain"]) > 0).cast("int"))
    return df.filter(F.col(on["gain"]).isNotNull()) if drop_missing else df


def with_state_bins(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Coarse state = (rating / 100, accuracy * 10, avg solved difficulty / 200)."""
    fn = feature_names(params)
    return df.withColumns({
        "bin_rating": state_bin(F.col(RATING) / F.lit(params.rating_bin), params.tie_mode),
        "bin_acc": state_bin(F.col(fn["acc"]) * F.lit(params.acc_bin_scale), params.tie_mode),
        "bin_diff": state_bin(F.col(fn["ok_diff"]) / F.lit(params.diff_bin), params.tie_mode),
    })


def cem_input(features: DataFrame, params: Params = Params()) -> DataFrame:
    """C1 + C2 rows (halo rows of a segmented frame removed)."""
    return strip(with_state_bins(with_outcome(features, params), params))


def cem_cells(cem: DataFrame, params: Params = Params()) -> DataFrame:
    """One pass over the rows: gain moments per (problem, state cell).

    Both the treated cells and the baseline derive from this table; it has at
    most problems x cells rows, far fewer than submissions.
    """
    on = outcome_names(params)
    g, imp = F.col(on["gain"]), F.col(on["improved"])
    return cem.groupBy(PID, *BINS).agg(
        F.avg(g).alias("treated_gain"),
        F.var_samp(g).alias("_var"),
        F.count(g).alias("treated_count"),
        F.avg(imp).alias("treated_improve_prob"),
    )


def written_cells(cem: DataFrame, params: Params = Params()) -> DataFrame:
    """``cem_cells`` as a table in the shared folder: the rows' windows run once for all readers."""
    return materialize(cem_cells(cem, params), "table")


def cem_treated(cells: DataFrame, params: Params = Params()) -> DataFrame:
    """C4: per (problem, state cell) treated stats, kept at >= the treated minimum."""
    return cells.filter(F.col("treated_count") >= F.lit(params.min_treated_prefilter)).select(
        PID, *BINS, "treated_gain", F.sqrt("_var").alias("treated_std"), "treated_count",
        "treated_improve_prob")


def _baselines(cells: DataFrame) -> DataFrame:
    """The cells' moments merged to one row for each bin combination (null bins are a cell too),
    some 7,600 with cleaned ratings: the same values as aggregating the rows again."""
    n_i = F.col("treated_count")
    parts = cells.filter(n_i > 0).select(
        *BINS, n_i.alias("gain_n"), F.col("treated_gain").alias("gain_mean"),
        F.coalesce((n_i - 1) * F.col("_var"), F.lit(0.0)).alias("gain_m2"),
        n_i.alias("improve_n"), F.col("treated_improve_prob").alias("improve_mean"), F.lit(0.0).alias("improve_m2"))
    return merged(parts, BINS, ["gain", "improve"]).select(
        *BINS, F.col("gain_mean").alias("baseline_gain"), F.sqrt(var_samp(F.col("gain_n"), F.col("gain_m2"))).alias("baseline_std"),
        F.col("gain_n").alias("baseline_count"), F.col("improve_mean").alias("baseline_improve_prob"))


def cem_baseline(cells: DataFrame, params: Params = Params()) -> DataFrame:
    """The all-rows mean gain per state cell (the control), kept at >= min_samples."""
    return _baselines(cells).filter(F.col("baseline_count") >= F.lit(params.min_samples))


def cem_effects(cells: DataFrame, params: Params = Params()) -> DataFrame:
    """Treated cells (>= the treated minimum) matched to their state
    cell's baseline (>= min_samples), uplift, variance, weight.

    Matching is exact on the three bins; a null bin matches nothing.
    """
    ms = F.lit(params.min_samples)
    matched = cells.filter(F.col("bin_rating").isNotNull() & F.col("bin_acc").isNotNull() & F.col("bin_diff").isNotNull())
    j = matched.join(_baselines(matched), BINS)
    j = j.filter((F.col("treated_count") >= F.lit(params.min_treated_prefilter))
                 & (F.col("treated_count") >= ms) & (F.col("baseline_count") >= ms))
    j = j.withColumn("treated_std", F.sqrt("_var"))
    j = j.withColumns({
        "uplift": F.col("treated_gain") - F.col("baseline_gain"),
        "bucket_variance": F.pow("treated_std", 2) / F.col("treated_count")
                           + F.pow("baseline_std", 2) / F.col("baseline_count"),
    }).filter(F.abs("uplift") <= F.lit(params.uplift_cap))
    j = j.withColumn("probability_uplift", F.col("treated_improve_prob") - F.col("baseline_improve_prob"))
    j = j.withColumn("total_treated_samples", F.sum("treated_count").over(Window.partitionBy(PID)))
    j = j.withColumn("weight", F.col("treated_count") / F.col("total_treated_samples"))
    return j.select(PID, *BINS, "treated_gain", "treated_std", "treated_count", "treated_improve_prob",
                    "baseline_gain", "baseline_std", "baseline_count", "baseline_improve_prob",
                    "uplift", "bucket_variance", "probability_uplift", "total_treated_samples", "weight")


def att_effects(effects: DataFrame) -> DataFrame:
    """Treatment effect on the treated per problem."""
    w = F.col("weight")
    return effects.groupBy(PID).agg(
        F.sum(w * F.col("uplift")).alias("att_score"),
        F.sum(F.pow(w, 2) * F.col("bucket_variance")).alias("att_variance"),
        F.max("total_treated_samples").alias("total_treated_samples"),
        F.avg("bin_rating").alias("avg_rating_level"),
        safe_div(F.sum(F.col("probability_uplift") * F.col("treated_count")),
                 F.sum("treated_count")).alias("att_probability_uplift"),
    )


def with_significance(att: DataFrame) -> DataFrame:
    """Standard error, z and the two-sided normal p-value as columns."""
    att = att.withColumn("att_std_err", F.sqrt("att_variance"))
    att = att.withColumn("z_score", z_score("att_score", "att_std_err"))
    return att.withColumn("p_value", normal_two_sided_p("z_score"))


def significant(att_sig: DataFrame, params: Params = Params()) -> DataFrame:
    """P below the threshold (NaN/null p never passes)."""
    return att_sig.filter(F.col("p_value") < F.lit(params.p_threshold))


def cohort_examples(cem_rows: DataFrame, sig: DataFrame, params: Params = Params()) -> DataFrame:
    """C11: up to k best gainers per significant problem.

    ``cem_rows`` are feature rows with outcomes. ``row_number() <= k`` lets
    Spark insert a partial WindowGroupLimit before the shuffle, so even a
    problem holding a third of all rows sends only k rows per task.
    """
    on = outcome_names(params)
    rows = cem_rows.filter(F.col(on["gain"]) > 0).join(sig.select(PID), PID, "left_semi")
    w = Window.partitionBy(PID).orderBy(F.desc(on["gain"]), F.asc(HANDLE),
                                        *[F.asc(c) for c in params.order_by if c in cem_rows.columns])
    rows = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= params.cohort_k)
    return rows.select(HANDLE, PID, F.col(RATING).alias("rating_before"),
                       F.col(on["future"]).alias("rating_after"), F.col(on["gain"]).alias("rating_gain"))


def att_detailed(effects: DataFrame, sig: DataFrame) -> DataFrame:
    """Cell rows of the significant problems."""
    return effects.join(sig.select(PID), PID, "left_semi")


# ---------------------------------------------------------------- X statistics

def att_bonferroni(att_sig: DataFrame, params: Params = Params()) -> DataFrame:
    """P * m capped at 1, m = problems with a p-value (a scalar subquery)."""
    m = att_sig.agg(F.count("p_value")).scalar()
    out = att_sig.withColumn("n_tests", m)
    p_adj = F.least(F.lit(1.0), F.col("p_value") * F.col("n_tests"))
    return out.select(PID, "att_score", "p_value", "n_tests", p_adj.alias("p_bonferroni"),
                      (p_adj < F.lit(params.p_threshold)).alias("significant_bonferroni"))


def att_cohens_d(effects: DataFrame) -> DataFrame:
    """Per cell uplift / pooled sd, weighted by the treated share."""
    n1, n2 = F.col("treated_count"), F.col("baseline_count")
    pooled = F.sqrt(safe_div((n1 - 1) * F.pow("treated_std", 2) + (n2 - 1) * F.pow("baseline_std", 2),
                             n1 + n2 - 2))
    d = safe_div(F.col("uplift"), pooled)
    return effects.groupBy(PID).agg(
        F.sum(F.col("weight") * d).alias("cohens_d"),
        F.sum("treated_count").alias("treated_samples"),
    )


def welch_stats(effects: DataFrame) -> DataFrame:
    """Welch t per problem (= ATT / se), its Welch-Satterthwaite degrees of freedom, and the
    two-sided p-value by the normal tail (``p_value``) and by Student's t (``p_value_t``)."""
    w2 = F.pow("weight", 2)
    a = w2 * F.pow("treated_std", 2) / F.col("treated_count")
    b = w2 * F.pow("baseline_std", 2) / F.col("baseline_count")
    g = effects.groupBy(PID).agg(
        F.sum(F.col("weight") * F.col("uplift")).alias("att_score"),
        F.sum(a + b).alias("att_variance"),
        F.sum(F.pow(a, 2) / (F.col("treated_count") - 1)
              + F.pow(b, 2) / (F.col("baseline_count") - 1)).alias("_den"),
    )
    g = g.withColumn("t_stat", z_score("att_score", F.sqrt("att_variance")))
    g = g.withColumn("welch_df", safe_div(F.pow("att_variance", 2), F.col("_den")))
    return g.select(PID, "att_score", "t_stat", "welch_df", normal_two_sided_p("t_stat").alias("p_value"),
                    student_two_sided_p("t_stat", "welch_df").alias("p_value_t"))


def with_intervals(att_sig: DataFrame, params: Params = Params()) -> DataFrame:
    """Att +- z * se (99 % by default, matching p < 0.01)."""
    half = F.lit(params.ci_z) * F.col("att_std_err")
    return att_sig.select(PID, "att_score", "att_std_err",
                          (F.col("att_score") - half).alias("ci_low"),
                          (F.col("att_score") + half).alias("ci_high"))


def covariate_cells(cem: DataFrame, params: Params = Params()) -> DataFrame:
    """Moments of the matching covariates per (problem, state cell): one pass over the rows."""
    fn = feature_names(params)
    covs = {"rating": F.col(RATING), "accuracy": F.col(fn["acc"]), "difficulty": F.col(fn["ok_diff"])}
    return cem.groupBy(PID, *BINS).agg(*[m for k, x in covs.items() for m in moments(x, k)])


def balance_check(cem: DataFrame, effects: DataFrame, params: Params = Params()) -> DataFrame:
    """Standardised mean difference of the matching covariates.

    Treated = rows of the problem in its matched cells; control = all rows of
    those cells, re-weighted by the treated share of each cell. Everything is
    merged from central moments per (problem, cell), written once; a cell's moments
    are an aggregate joined back, a problem's a window over its cells (some 7,600 at most).
    """
    names = ["rating", "accuracy", "difficulty"]
    own = materialize(covariate_cells(cem, params), "table")
    cells = merged(own, BINS, names).withColumnsRenamed({f"{x}_{m}": f"c_{x}_{m}" for x in names for m in ("n", "mean", "m2")})
    j = null_safe(own, cells, BINS).join(effects.select(PID, *BINS, "weight"), [PID, *BINS], "inner")
    j = j.select(PID, "weight", F.explode(F.array(*[
        F.struct(F.lit(x).alias("covariate"), *[F.col(f"{p}{x}_{m}").alias(f"{p}{m}") for p in ("", "c_") for m in ("n", "mean", "m2")])
        for x in names])).alias("c")).select(PID, "weight", "c.*")
    w = Window.partitionBy(PID, "covariate")
    j = j.withColumns({
        "mt": safe_div(F.sum(F.col("n") * F.col("mean")).over(w), F.sum("n").over(w)),
        "mc": F.sum(F.col("weight") * F.col("c_mean")).over(w),
    })
    g = j.groupBy(PID, "covariate", "mt", "mc").agg(
        F.sum("n").alias("nt"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("mt"), 2)).alias("m2t"),
        # variance of the weighted mixture of cells: within and between them
        F.sum(F.col("weight") * (safe_div("c_m2", "c_n") + F.pow(F.col("c_mean") - F.col("mc"), 2))).alias("var_c"))
    spread = F.sqrt((var_samp(F.col("nt"), F.col("m2t")) + F.col("var_c")) / 2)
    return g.select(PID, "covariate", F.col("mt").alias("treated_mean"), F.col("mc").alias("control_mean"),
                    safe_div(F.col("mt") - F.col("mc"), spread).alias("smd"))


def att_effects_solvers(cem: DataFrame, params: Params = Params()) -> DataFrame:
    """treated = solvers of the problem, control = every other row of the same cell.

    One pass over the rows into moments per (problem, cell, solved), written once. A cell's
    moments are merged from them and joined back; the control is the cell with the
    solvers taken out again (``moments.without``).
    """
    on = outcome_names(params)
    solved = F.coalesce(F.col(VERDICT) == F.lit(OK), F.lit(False)).alias("_solved")
    rows = cem.filter(F.col("bin_rating").isNotNull() & F.col("bin_acc").isNotNull() & F.col("bin_diff").isNotNull())
    parts = materialize(rows.groupBy(PID, *BINS, solved).agg(
        *moments(F.col(on["gain"]), "g"), F.sum(F.col(on["improved"]).cast("double")).alias("imp")), "table")
    total = merged(parts, BINS, ["g"]).withColumnsRenamed({"g_n": "a_n", "g_mean": "a_mean", "g_m2": "a_m2"})
    imp = parts.groupBy(*BINS).agg(F.sum("imp").alias("a_imp"))
    j = parts.filter("_solved").join(total, BINS).join(imp, BINS)
    n, mean, m2 = F.col("g_n"), F.col("g_mean"), F.col("g_m2")
    c_n, c_mean, c_m2 = without((F.col("a_n"), F.col("a_mean"), F.col("a_m2")), (n, mean, m2))
    j = j.withColumns({"c_n": c_n, "c_mean": c_mean, "c_m2": c_m2, "c_imp": F.col("a_imp") - F.col("imp")})
    ms = F.lit(params.min_samples)
    j = j.filter((n >= ms) & (F.col("c_n") >= ms))
    j = j.withColumns({
        "uplift": mean - F.col("c_mean"),
        "bucket_variance": var_samp(n, m2) / n + var_samp(F.col("c_n"), F.col("c_m2")) / F.col("c_n"),
        "probability_uplift": F.col("imp") / n - F.col("c_imp") / F.col("c_n"),
    }).filter(F.abs("uplift") <= F.lit(params.uplift_cap))
    j = j.withColumn("total_treated_samples", F.sum(n).over(Window.partitionBy(PID)))
    j = j.withColumn("weight", n / F.col("total_treated_samples"))
    att = j.groupBy(PID).agg(
        F.sum(F.col("weight") * F.col("uplift")).alias("att_score"),
        F.sum(F.pow("weight", 2) * F.col("bucket_variance")).alias("att_variance"),
        F.max("total_treated_samples").alias("total_treated_samples"),
        safe_div(F.sum(F.col("probability_uplift") * n), F.sum(n)).alias("att_probability_uplift"),
    )
    return with_significance(att)
