"""Per-user rolling features (F1-F8), leakage free.

Every rolling statistic covers the ``history`` rows *before* the current one
and is defined only on a full window (see ``full_window``). All windows share
one spec, so the plan has one exchange on ``handle`` and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import full_window, safe_div
from ..functions.segments import HALO, IDX, SEG
from ..functions.sequence import feature_names, history_frame, trailing_frame, user_window
from ..params import Params
from ..schema import OK, PID, RATING, TIME, VERDICT


def user_features(subs: DataFrame, difficulty: DataFrame, params: Params = Params()) -> DataFrame:
    """F1-F8. ``difficulty`` has (problem id, estimated_difficulty); pass it
    already broadcast when its size is checked (see ``plans.Analysis``).
    ``subs`` may be segmented (``functions.segments``); the output then keeps
    the segment columns and halo rows for the windows downstream."""
    n = params.history
    names = feature_names(params)
    w = user_window(params, df=subs)
    h = history_frame(params, df=subs)
    df = subs.join(difficulty.select(PID, "estimated_difficulty"), PID, "left")
    # null verdict -> null flag, so every window touching it is null
    is_ok = (F.col(VERDICT) == F.lit(OK)).cast("int")
    df = df.withColumns({
        "_ok": is_ok,
        "_wd": F.coalesce(F.col("estimated_difficulty"), F.lit(0.0)) * is_ok,
        "_one": F.lit(1),
    })
    solve_cnt = full_window(F.sum, "_ok", h, n)
    df = df.withColumns({
        names["acc"]: full_window(F.avg, "_ok", h, n),
        names["solve_cnt"]: solve_cnt.cast("int"),
        "_wsum": full_window(F.sum, "_wd", h, n),
        "time_since_last_sub": F.col(TIME) - F.lag(TIME, 1).over(w),
        names["sub_cnt"]: full_window(F.count, "_one", h, n).cast("int"),
        "_delta": F.col(RATING) - F.lag(RATING, 1).over(w),
    })
    df = df.withColumns({
        # 0/0 and warm-up both give 0.0
        names["ok_diff"]: F.coalesce(safe_div("_wsum", names["solve_cnt"]), F.lit(0.0)),
        names["rating_delta"]: full_window(F.avg, "_delta", trailing_frame(params, df=subs), n),
    })
    df = df.filter(F.col(names["sub_cnt"]) >= F.lit(params.min_submissions))
    ordered = [c for c in subs.columns if c not in (SEG, IDX, HALO)] + ["estimated_difficulty", names["acc"], names["solve_cnt"],
                                           "time_since_last_sub", names["sub_cnt"], names["ok_diff"],
                                           names["rating_delta"]]
    ordered += [c for c in (SEG, IDX, HALO) if c in subs.columns]
    return df.select(*ordered)
