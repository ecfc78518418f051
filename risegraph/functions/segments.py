"""Splitting the histories of heavy users so per-user windows stay parallel.

A per-user window puts a whole history in one task. When one user may hold a
third of all rows, that task is the job. For users above
``params.hot_user_rows`` rows this module

1. gives every row an exact 0-based position ``_idx`` in the user's order:
   the hot rows are range-partitioned on (handle, order, input id), which
   splits even a single user (and exact duplicate rows) across many
   partitions; ``monotonically_increasing_id`` then numbers rows within a
   partition, a reliable checkpoint pins those numbers (they depend on
   partition layout), and per-(user, partition) counts turn them into global
   positions (a prefix sum over a table with one row per partition);
2. cuts the history into segments of ``segment_rows`` rows, ``_seg``;
3. copies the last ``back`` rows of each segment into the next one and the
   first ``fwd`` rows into the previous one as *halo* rows (``_halo``), so
   every window frame that reaches at most ``back`` rows back and ``fwd``
   rows ahead sees exactly the rows it would see on the whole history.

Windows then run on ``partitionBy(handle, _seg)`` ordered by the user order
and ``_idx``; results of halo rows are dropped. Other users keep ``_seg = 0``
and no ``_idx``, so for them the plan is the plain per-user window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from ..schema import HANDLE
from ..session import broadcast_if_small, materialize

SEG, IDX, HALO = "_seg", "_idx", "_halo"


def is_segmented(df: DataFrame) -> bool:
    return SEG in df.columns


def hot_users(subs: DataFrame, params: Params) -> DataFrame:
    """Users with more than ``hot_user_rows`` rows and their row counts."""
    return (subs.groupBy(HANDLE).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > F.lit(params.hot_user_rows)))


def index_hot_users(subs: DataFrame, params: Params) -> DataFrame:
    """Add ``_seg`` / ``_idx`` (see module doc). Returns ``subs`` unchanged when
    no user is above the threshold (the common case costs one aggregate).

    """
    if params.hot_user_rows is None:
        return subs
    # one job computes and caches the hot users and their totals; a user above
    # the threshold holds > hot_user_rows rows, so the table has fewer than
    # rows / hot_user_rows entries, and its size is checked before broadcasting
    hot = materialize(hot_users(subs, params), "persist")
    stats = hot.agg(F.count(F.lit(1)).alias("users"), F.sum("_n").alias("rows")).first()
    if not stats["users"]:
        hot.unpersist()
        return subs
    seg_rows = params.segment_rows
    keys = hot.select(HANDLE)
    if stats["users"] <= params.broadcast_max_rows:
        keys = F.broadcast(keys)
    plain = subs.join(keys, HANDLE, "left_anti").withColumns(
        {SEG: F.lit(0).cast("long"), IDX: F.lit(None).cast("long")})
    h = subs.join(keys, HANDLE, "left_semi").withColumn("_in", F.monotonically_increasing_id())
    n_parts = max(1, math.ceil(stats["rows"] / max(params.index_partition_rows, 1)))
    order = [HANDLE, *params.order_by, "_in"]
    h = h.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    h = h.withColumn("_mid", F.monotonically_increasing_id())
    h = materialize(h, "checkpoint")  # pins _in/_mid against recomputation
    part = F.shiftright(F.col("_mid"), 33)
    t = h.groupBy(HANDLE, part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    before = Window.partitionBy(HANDLE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    # one row per (hot user, range partition): at most n_parts + users rows
    t, _ = broadcast_if_small(t.select(HANDLE, "_part", "_off", "_m0"), params.broadcast_max_rows)
    h = h.withColumn("_part", part).join(t, [HANDLE, "_part"], "inner")
    idx = F.col("_off") + F.col("_mid") - F.col("_m0")
    h = h.withColumn(IDX, idx).withColumn(SEG, F.floor(F.col(IDX) / F.lit(seg_rows)).cast("long"))
    h = h.drop("_in", "_mid", "_part", "_off", "_m0")
    return plain.unionByName(h)


def with_halo(df: DataFrame, params: Params, back: int, fwd: int) -> DataFrame:
    """Copy boundary rows of hot-user segments into the neighbouring segments."""
    if not is_segmented(df):
        return df
    seg_rows = params.segment_rows
    if back >= seg_rows or fwd >= seg_rows:
        raise ValueError("segment_rows must exceed the halo width")
    pos = F.col(IDX) % F.lit(seg_rows)
    base = df.withColumn(HALO, F.lit(False))
    hot = df.filter(F.col(IDX).isNotNull())
    parts = [base]
    if back:
        parts.append(hot.filter(pos >= F.lit(seg_rows - back))
                     .withColumns({SEG: F.col(SEG) + 1, HALO: F.lit(True)}))
    if fwd:
        parts.append(hot.filter((pos < F.lit(fwd)) & (F.col(SEG) > 0))
                     .withColumns({SEG: F.col(SEG) - 1, HALO: F.lit(True)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_halo(df: DataFrame) -> DataFrame:
    if HALO in df.columns:
        return df.filter(~F.col(HALO)).drop(HALO)
    return df


def strip(df: DataFrame) -> DataFrame:
    """Back to plain per-user rows (no halo rows, no segment columns)."""
    return drop_halo(df).drop(SEG, IDX)


def halo_width(params: Params) -> tuple[int, int]:
    """Rows back / ahead that features + outcome + placebo + paths need:
    features look ``history`` rows back (+1 for the rating delta); rows whose
    own features are needed by a later lag of ``max(past, lags)`` rows add
    that much again; the outcome looks ``future`` rows ahead."""
    lag = max([params.past, params.history, *params.pre_trend_lags]) + 1
    return params.history + 1 + lag, params.future


def running_sum(df: DataFrame, value: str, out: str, params: Params) -> DataFrame:
    """Inclusive running sum of ``value`` along each user's order, exact across
    segments: a per-segment running sum plus the totals of the user's earlier
    segments (a table with one row per segment). ``df`` must be halo free."""
    from ..functions.sequence import running_frame
    local = F.sum(value).over(running_frame(params, df=df))
    if not is_segmented(df):
        return df.withColumn(out, local)
    tot = df.filter(F.col(IDX).isNotNull()).groupBy(HANDLE, SEG).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(HANDLE).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).select(HANDLE, SEG, "_o")
    tot, _ = broadcast_if_small(tot, params.broadcast_max_rows)
    return (df.join(tot, [HANDLE, SEG], "left")
            .withColumn(out, local + F.coalesce(F.col("_o"), F.lit(0))).drop("_o"))


def resegment(df: DataFrame, index_col: str, params: Params, back: int, fwd: int) -> DataFrame:
    """Re-cut a hot user's sub-stream (e.g. solves only) by its own 0-based
    index ``index_col`` and add halos; other users stay in segment 0."""
    hot = F.col(IDX).isNotNull()
    df = df.withColumns({
        SEG: F.when(hot, F.floor(F.col(index_col) / F.lit(params.segment_rows))).otherwise(F.lit(0)).cast("long"),
        IDX: F.when(hot, F.col(index_col)).cast("long"),
    })
    return with_halo(df, params, back, fwd)
