"""Per-user ordered-history windows.

A user's history is ordered by ``params.order_by`` (time first, then any
tiebreak columns), so every lag/lead/rolling frame is deterministic. All
operators that look along a history use these specs; Spark then shares one
exchange on ``handle`` and one sort between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec

from ..params import Params
from ..schema import HANDLE
from .segments import IDX, SEG, is_segmented


def user_window(params: Params, *extra_partition: str, df: DataFrame | None = None) -> WindowSpec:
    """Per-user history order. On a segmented frame (see ``segments``) the
    partition is (handle, segment) and the global row index breaks ties."""
    if df is not None and is_segmented(df):
        return Window.partitionBy(HANDLE, SEG, *extra_partition).orderBy(*params.order_by, IDX)
    return Window.partitionBy(HANDLE, *extra_partition).orderBy(*params.order_by)


def history_frame(params: Params, n: int | None = None, df: DataFrame | None = None) -> WindowSpec:
    """The ``n`` rows before the current one (rows -n .. -1)."""
    n = params.history if n is None else n
    return user_window(params, df=df).rowsBetween(-n, -1)


def trailing_frame(params: Params, n: int | None = None, df: DataFrame | None = None) -> WindowSpec:
    """The current row and the ``n - 1`` rows before it."""
    n = params.history if n is None else n
    return user_window(params, df=df).rowsBetween(-(n - 1), 0)


def running_frame(params: Params, df: DataFrame | None = None) -> WindowSpec:
    return user_window(params, df=df).rowsBetween(Window.unboundedPreceding, 0)


def feature_names(params: Params) -> dict[str, str]:
    n = params.history
    return {
        "acc": f"roll_acc_{n}",
        "solve_cnt": f"roll_solve_cnt_{n}",
        "ok_diff": f"roll_ok_diff_{n}",
        "sub_cnt": f"roll_sub_cnt_{n}",
        "rating_delta": f"roll_rating_delta_{n}",
    }


def outcome_names(params: Params) -> dict[str, str]:
    n = params.future
    return {"future": f"future_rating_{n}", "gain": f"rating_gain_{n}", "improved": f"improved_{n}"}
