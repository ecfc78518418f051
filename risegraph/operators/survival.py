"""Time to improvement (T1-T7 as the reference codes it, T8 as it documents it,
X1 Kaplan-Meier, X11 time quantiles).

T1-T7: a solve sets a reference rating (forward filled until the next solve);
a later row of the user at >= that rating + delta is an improvement event. The
pair key is the (handle, problem) of the solve row and of the event row, so as
coded an event counts only on rows of the solved problem itself (D7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from ..functions.quantiles import rank_quantiles
from ..functions.segments import IDX, SEG, drop_halo, is_segmented, strip
from ..functions.sequence import running_frame, user_window
from ..session import broadcast_if_small, materialize
from ..params import Params
from ..schema import HANDLE, OK, PID, RATING, VERDICT


def _feature_row_index(df: DataFrame, params: Params) -> F.Column:
    """0-based index among a user's feature rows: the global index of a
    segmented hot user (features start at row ``history``), else row_number."""
    rn = (F.row_number().over(user_window(params, df=df)) - 1).cast("long")
    if is_segmented(df):
        return F.when(F.col(IDX).isNotNull(), F.col(IDX) - F.lit(params.history)).otherwise(rn)
    return rn


def _solve_seeds(df: DataFrame, params: Params) -> DataFrame:
    """Per hot-user segment: the rating at the user's last solve before the
    segment starts (a table with one row per segment)."""
    core = drop_halo(df).filter(F.col(IDX).isNotNull())
    segs = core.select(HANDLE, SEG).distinct()
    last = core.filter(F.col("is_solve") == 1).groupBy(HANDLE, SEG).agg(F.max_by(RATING, IDX).alias("_r"))
    before = Window.partitionBy(HANDLE).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    seeds = segs.join(last, [HANDLE, SEG], "left").withColumn("_seed", F.last("_r", ignorenulls=True).over(before))
    return seeds.select(HANDLE, SEG, "_seed")


def survival_rows(features: DataFrame, params: Params = Params()) -> DataFrame:
    """Rating at the latest solve, per-user row index, improvement flag.

    On a segmented frame the forward fill runs per segment and falls back to
    the rating of the last solve before the segment (a small seed table)."""
    solve = (F.col(VERDICT) == F.lit(OK)).cast("int")
    df = features.withColumn("is_solve", solve)
    df = df.withColumns({
        "rating_at_solve": F.last(F.when(F.col("is_solve") == 1, F.col(RATING)), ignorenulls=True)
                            .over(running_frame(params, df=df)),
        "submission_idx": _feature_row_index(df, params),
    })
    if is_segmented(df):
        seeds, _ = broadcast_if_small(_solve_seeds(df, params), params.broadcast_max_rows)
        df = df.join(seeds, [HANDLE, SEG], "left").withColumn(
            "rating_at_solve", F.coalesce(F.col("rating_at_solve"), F.col("_seed"))).drop("_seed")
        df = strip(df)
    df = df.withColumn("improved_event",
                       (F.col(RATING) >= F.col("rating_at_solve") + F.lit(params.survival_delta)).cast("int"))
    return df.filter(F.col("rating_at_solve").isNotNull())


def survival_pairs(rows: DataFrame) -> DataFrame:
    """T4-T5: first solve and first event index per (handle, problem), as one
    conditional aggregate (no second group-by and join); negative times dropped."""
    g = rows.groupBy(HANDLE, PID).agg(
        F.min(F.when(F.col("is_solve") == 1, F.col("submission_idx"))).alias("solve_time"),
        F.min(F.when(F.col("improved_event") == 1, F.col("submission_idx"))).alias("event_time"),
    ).filter(F.col("solve_time").isNotNull())
    g = g.withColumns({
        "time_to_event": F.col("event_time") - F.col("solve_time"),
        "event_observed": F.col("event_time").isNotNull().cast("int"),
    })
    return g.filter((F.col("time_to_event") >= 0) | (F.col("event_observed") == 0))


def time_counts(pairs: DataFrame, time_col: str = "time_to_event") -> DataFrame:
    """Pairs counted by (problem, time), a null time for those without event: written once, it
    serves rates, sizes and quantiles. Partial counts in each task split a hot problem."""
    t = F.when(F.col("event_observed") == 1, F.col(time_col))
    return materialize(pairs.groupBy(PID, t.alias("t")).agg(F.count(F.lit(1)).alias("n")), "table")


def survival_effects(pairs: DataFrame, params: Params = Params()) -> DataFrame:
    """Event rate, exact median time, sample size >= minimum, hazard-style ratio.

    The median is found by rank selection over the counted times, so no task holds the times of a
    problem. The mean event rate over kept problems is a scalar subquery (one value),
    not an unpartitioned window.
    """
    counts = time_counts(pairs)
    n = F.col("n")
    per = counts.groupBy(PID).agg(
        (F.sum(F.when(F.col("t").isNotNull(), n).otherwise(F.lit(0))) / F.sum(n)).alias("event_rate"),
        F.sum(n).alias("sample_size"),
    ).filter(F.col("sample_size") >= F.lit(params.min_survival_samples))
    medians = rank_quantiles(counts, [PID], "t", "n", [0.5]).select(PID, F.col("q")[0].alias("median_time_to_improve"))
    mean_rate = per.agg(F.avg("event_rate")).scalar()
    return per.join(medians, PID, "left").select(
        PID, "event_rate", "median_time_to_improve", "sample_size",
        F.coalesce(safe_div(F.col("event_rate"), mean_rate), F.lit(1.0)).alias("hazard_ratio"))


def time_quantiles(pairs: DataFrame, time_col: str = "time_to_event") -> DataFrame:
    """X11: median and 75th percentile of observed times per problem, exact, by rank selection."""
    q = rank_quantiles(time_counts(pairs, time_col), [PID], "t", "n", [0.5, 0.75])
    return q.select(PID, F.col("q")[0].alias("median_time"), F.col("q")[1].alias("p75_time"), F.col("total").alias("observed"))


def kaplan_meier(durations: DataFrame, time_col: str = "time_to_event",
                 event_col: str = "event_observed") -> DataFrame:
    """Kaplan-Meier survival curve per problem.

    ``durations`` has (problem, time, event flag); a censored row's time is its
    follow-up length. Per (problem, t): d events, c censored; at-risk n(t) is a
    reverse running sum; S(t) = prod (1 - d/n) as exp(sum log), exactly 0 from
    the first t where d = n. One shuffle by problem; the window runs over
    distinct times only (bounded by the longest history).
    """
    per_t = durations.groupBy(PID, F.col(time_col).alias("t")).agg(
        F.sum(F.col(event_col)).cast("long").alias("events"),
        F.sum(1 - F.col(event_col)).cast("long").alias("censored"),
    )
    later = Window.partitionBy(PID).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    upto = Window.partitionBy(PID).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    per_t = per_t.withColumn("at_risk", F.sum(F.col("events") + F.col("censored")).over(later))
    step = F.col("events") / F.col("at_risk")
    per_t = per_t.withColumns({
        "_log": F.when(step < 1, F.log1p(-step)),
        "_zero": (step >= 1).cast("int"),
    })
    surv = F.when(F.max("_zero").over(upto) == 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.coalesce("_log", F.lit(0.0))).over(upto)))
    return per_t.select(PID, F.col("t").alias("time"), "at_risk", "events", "censored", surv.alias("survival"))


def _with_maxima(units: DataFrame, block: int) -> DataFrame:
    """(handle, seg, maxima): each run of ``block`` consecutive units as a sparse table, an array of
    arrays; ``maxima[k][i]`` is the greatest value of units i .. i + 2^k - 1 of the run (cut at its end).
    A run has ``block`` units at most, so no task gathers a whole history."""
    runs = units.groupBy(HANDLE, "seg").agg(F.array_sort(F.collect_list(F.struct("unit", "mx"))).alias("_u"))
    widths = F.array(*[F.lit(1 << k) for k in range((block - 1).bit_length() - 1)]).cast("array<int>")
    own = F.transform("_u", lambda u: u["mx"])

    def wider(acc, w):
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.transform(last, lambda x, i: F.greatest(x, F.get(last, i + w)))))

    return runs.select(HANDLE, "seg", F.aggregate(widths, F.array(own), wider).alias("maxima"))


def _first_in_run(maxima: F.Column, start: F.Column, th: F.Column, block: int) -> F.Column:
    """Place of the first unit at or after ``start`` whose value reaches ``th``, or null: binary
    lifting, a stretch of 2^k units is stepped over when its maximum is too small."""
    ks = F.array(*[F.lit(k) for k in range((block - 1).bit_length() - 1, -1, -1)])

    def over(at, k):
        low = F.get(F.get(maxima, k), at) < th
        return F.when(low, at + F.pow(F.lit(2), k).cast("int")).otherwise(at)

    at = F.aggregate(ks, start.cast("int"), over)
    return F.when(F.get(F.get(maxima, F.lit(0)), at) >= th, at)


def first_reaching(rows: DataFrame, queries: DataFrame, block: int = 1024, levels: int = 3) -> DataFrame:
    """For each query (handle, qid, start, th): the first row index > start whose
    rating >= th, or null. Exact; raises where a history has more than
    block^(levels+1) rows (2^40 by default). ``rows`` (handle, idx, rating) numbers each
    history from 0 without gaps.

    Rows lie in runs of ``block`` units, each a sparse table of power-of-two maxima; the units of the
    next level are the runs' maxima. A query looks into the one run that holds its start; where nothing
    there reaches ``th``, into the one run of runs, and so on; then down again, one run a level. So it
    meets 2 * levels + 1 rows, each searched by binary lifting in log2(block) steps: O(log n). Joins are
    equi-joins on (handle, run) against one row each, and run keys spread one heavy user over many tasks.
    """
    if block < 2:
        raise ValueError("a run needs two units at least")
    b = F.lit(block)
    units = rows.select(HANDLE, F.col("idx").alias("unit"), F.col(RATING).alias("mx"))
    short = F.raise_error(F.lit(f"a history is longer than {block}^{levels + 1} rows: more levels are needed"))
    tables = []
    for k in range(levels + 1):
        seg = F.floor(F.col("unit") / b).cast("long")
        units = units.withColumn("seg", seg if k < levels else F.when(seg > 0, short.cast("long")).otherwise(seg))
        t = _with_maxima(units, block)
        tables.append(t.withColumnsRenamed({HANDLE: "_user", "seg": "_seg"}))
        units = t.select(HANDLE, F.col("seg").alias("unit"), F.array_max(F.col("maxima")[0]).alias("mx"))
    cur = queries.select(HANDLE, "qid", "th", F.col("start").cast("long").alias("unit"), F.lit(None).cast("int").alias("lvl"))
    here = (F.col(HANDLE) == F.col("_user")) & (F.col("_own") == F.col("_seg"))
    for k in range(levels + 1):  # up: lvl is the level where the first hit was found
        own = F.floor(F.col("unit") / b).cast("long")
        # a query that has its hit meets no run; its key stays spread
        cur = cur.withColumn("_own", F.when(F.col("lvl").isNull(), own).otherwise(-1 - own))
        j = cur.join(tables[k], here, "left")
        at = _first_in_run(F.col("maxima"), F.col("unit") % b + 1, F.col("th"), block)
        j = j.withColumn("_at", F.when(F.col("lvl").isNull(), at))
        cur = j.select(HANDLE, "qid", "th", F.when(F.col("_at").isNotNull(), F.col("_own") * b + F.col("_at"))
                       .when(F.col("lvl").isNull(), F.col("_own")).otherwise(F.col("unit")).alias("unit"),
                       F.when(F.col("_at").isNotNull(), F.lit(k)).otherwise(F.col("lvl")).alias("lvl"))
    cur = cur.filter(F.col("lvl").isNotNull())
    for k in range(levels, 0, -1):  # down: the first unit of the run that the hit stands for
        cur = cur.withColumn("_own", F.when(F.col("lvl") == k, F.col("unit")).otherwise(-1 - F.col("unit")))
        j = cur.join(tables[k - 1], here, "left")
        at = _first_in_run(F.col("maxima"), F.lit(0), F.col("th"), block)
        cur = j.select(HANDLE, "qid", "th", F.when(F.col("lvl") == k, F.col("unit") * b + at).otherwise(F.col("unit")).alias("unit"),
                       F.when(F.col("lvl") == k, F.lit(k - 1)).otherwise(F.col("lvl")).alias("lvl"))
    return cur.select(HANDLE, "qid", F.col("unit").alias("event_idx"))


def levels_for(max_rows: int, block: int = 1024) -> int:
    """Fewest block levels so that block^(levels+1) exceeds the longest history."""
    levels = 0
    while block ** (levels + 1) <= max(int(max_rows), 1):
        levels += 1
    return levels


def time_to_improve(features: DataFrame, params: Params = Params(), block: int = 1024,
                    levels: int = 3) -> DataFrame:
    """T8 (the documented meaning): from the first solve of a problem, the number
    of submissions until the user's rating first reaches the rating at that
    solve + delta, on any problem. Unobserved -> censored at the history end;
    ``duration`` is the time for observed rows and the follow-up otherwise."""
    base = drop_halo(features)
    rows = base.withColumn("idx", _feature_row_index(base, params))
    # the features' windows run once: queries, runs and ends of histories read this narrow table
    rows = materialize(rows.select(HANDLE, PID, VERDICT, RATING, "idx"), "table")
    solves = rows.filter(F.col(VERDICT) == F.lit(OK)).groupBy(HANDLE, PID).agg(
        F.min_by(F.struct(F.col("idx").alias("i"), F.col(RATING).alias("r")), F.col("idx")).alias("_s"))
    solves = solves.select(HANDLE, PID, F.col("_s.i").alias("solve_idx"), F.col("_s.r").alias("solve_rating"))
    queries = solves.select(HANDLE, F.col(PID).alias("qid"), F.col("solve_idx").alias("start"),
                            (F.col("solve_rating") + F.lit(params.survival_delta)).alias("th"))
    found = first_reaching(rows.select(HANDLE, "idx", RATING), queries, block, levels)
    last = rows.groupBy(HANDLE).agg(F.max("idx").alias("_last"))
    out = (solves.join(found.withColumnRenamed("qid", PID), [HANDLE, PID], "left")
           .join(last, HANDLE, "inner"))
    observed = F.col("event_idx").isNotNull()
    return out.select(
        HANDLE, PID, "solve_idx", "solve_rating", "event_idx",
        (F.col("event_idx") - F.col("solve_idx")).alias("time_to_improve"),
        observed.cast("int").alias("event_observed"),
        F.when(observed, F.col("event_idx") - F.col("solve_idx"))
         .otherwise(F.col("_last") - F.col("solve_idx")).alias("duration"),
    )
