"""Placebo checks: reversed-time gain (V1-V7), pre-trends over several lags
(X6), and randomly relabelled problems (X7).

If solving a problem *caused* later gains, the gain over the rows *before*
solving should not differ from same-state users (selection bias ~ 0), and a
random relabelling of problems should show no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segments import strip
from ..functions.sequence import user_window
from ..params import Params
from ..schema import BINS, HANDLE, PID, RATING, TIME
from ..session import materialize
from . import matching as C


def _bias(df: DataFrame, keys_extra: list[str], params: Params) -> DataFrame:
    """V3-V6 on a frame with (placebo_gain, placebo_improved, bins).

    One pass over the rows into (problem, cell) means and counts, written once; the baseline
    cell means are count-weighted merges of that small table, joined back to it.
    """
    mc = F.lit(params.placebo_min_count)
    n = F.col("treated_count")
    matched = F.col("bin_rating").isNotNull() & F.col("bin_acc").isNotNull() & F.col("bin_diff").isNotNull()
    cells = df.filter(matched).groupBy(*keys_extra, PID, *BINS).agg(
        F.avg("placebo_gain").alias("treated_placebo_gain"),
        F.count("placebo_gain").alias("treated_count"),
        F.avg("placebo_improved").alias("treated_placebo_improve_prob"),
    )
    j = materialize(cells.filter(n > 0), "table")
    keys = [*keys_extra, *BINS]
    # one row for each bin combination
    j = j.join(j.groupBy(*keys).agg(
        F.sum(n).alias("baseline_count"),  # D9: counted inside the aggregate
        (F.sum(n * F.col("treated_placebo_gain")) / F.sum(n)).alias("baseline_placebo_gain"),
        (F.sum(n * F.col("treated_placebo_improve_prob")) / F.sum(n)).alias("baseline_placebo_improve_prob")), keys)
    j = j.filter((F.col("baseline_count") >= mc) & (n >= mc))
    j = j.withColumn("selection_bias", F.col("treated_placebo_gain") - F.col("baseline_placebo_gain"))
    j = j.filter(F.abs("selection_bias") <= F.lit(params.uplift_cap))
    j = j.withColumn("probability_selection_bias",
                     F.col("treated_placebo_improve_prob") - F.col("baseline_placebo_improve_prob"))
    return j.groupBy(*keys_extra, PID).agg(
        (F.sum(F.col("selection_bias") * n) / F.sum(n)).alias("bias_score"),
        (F.sum(F.col("probability_selection_bias") * n) / F.sum(n)).alias("probability_bias_score"),
        F.sum(n).alias("total_samples"),
    )


def placebo_rows(features: DataFrame, params: Params = Params()) -> DataFrame:
    """V1-V2: gain over the previous ``past`` rows, flag, bins."""
    w = user_window(params, df=features)
    df = features.withColumn("placebo_gain", F.col(RATING) - F.lag(RATING, params.past).over(w))
    df = strip(df).filter(F.col("placebo_gain").isNotNull())
    df = df.withColumn("placebo_improved", (F.col("placebo_gain") > 0).cast("int"))
    return C.with_state_bins(df, params)


def placebo_bias(features: DataFrame, params: Params = Params()) -> DataFrame:
    """V3-V6: selection bias per problem."""
    return _bias(placebo_rows(features, params), [], params)


def placebo_summary(bias: DataFrame) -> DataFrame:
    """V7: unweighted mean bias over problems (null when there is none)."""
    return bias.agg(F.avg("bias_score").alias("mean_bias_score"), F.count(F.lit(1)).alias("problems"))


def pre_trend(features: DataFrame, params: Params = Params()) -> DataFrame:
    """The placebo at several lags; the lagged gains are one array exploded
    in a second projection (one window pass for all lags)."""
    w = user_window(params, df=features)
    lags = list(params.pre_trend_lags)
    gains = F.array(*[F.struct(F.lit(L).alias("lag"), (F.col(RATING) - F.lag(RATING, L).over(w)).alias("g"))
                      for L in lags])
    df = strip(features.withColumn("_g", gains))
    cols = df.columns[:-1]
    df = df.select(*cols, F.explode("_g").alias("_x"))
    df = df.select(*cols, F.col("_x.lag").alias("lag"), F.col("_x.g").alias("placebo_gain"))
    df = df.filter(F.col("placebo_gain").isNotNull())
    df = df.withColumn("placebo_improved", (F.col("placebo_gain") > 0).cast("int"))
    return _bias(C.with_state_bins(df, params), ["lag"], params)


def random_problem_ids(features: DataFrame, n_problems) -> DataFrame:
    """Replace the problem id by a pseudo-random one of ``n_problems``
    labels, from md5 of (handle, time): reproducible in any engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(HANDLE), F.col(TIME).cast("string"))), 1, 8), 16, 10)
    label = F.pmod(h.cast("long"), n_problems)
    return features.withColumn(PID, F.concat(F.lit("R"), label.cast("string")))


def random_placebo(features: DataFrame, metadata: DataFrame, params: Params = Params()) -> DataFrame:
    """C1-C9 on randomly relabelled problems; effects should vanish. There are as many
    labels as problems in ``metadata`` (also those without feature rows)."""
    n = metadata.agg(F.count(F.lit(1))).scalar()
    cells = C.written_cells(C.cem_input(random_problem_ids(features, n), params), params)
    eff = C.cem_effects(cells, params)
    return C.with_significance(C.att_effects(eff))
