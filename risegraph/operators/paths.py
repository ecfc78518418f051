"""Transition graph (G1-G5), improvement paths (P1-P3), n-gram and gapped patterns.

All per-user sequence work is windows over the history already partitioned by
``handle``; the five shifted frames of the reference become one array of
``lead`` values exploded in a second projection (one scan, one exchange).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import full_window
from ..functions.segments import HALO, IDX, SEG, drop_halo, is_segmented, resegment, running_sum, strip
from ..functions.sequence import trailing_frame, user_window
from ..params import Params
from ..schema import HANDLE, OK, PID, RATING, TIME, VERDICT
from ..session import materialize


def solved_history(features: DataFrame, params: Params = Params()) -> DataFrame:
    """G1: solved rows only, with the per-user solve index.

    On a segmented frame the solve index is a segmented running count of
    solves, and the solve stream is re-cut by it (halo: the previous
    ``path_len`` and next ``transition_window`` solves)."""
    ok = F.coalesce(F.col(VERDICT) == F.lit(OK), F.lit(False))
    if not is_segmented(features):
        cols = list(dict.fromkeys([HANDLE, PID, *params.order_by]))
        s = features.filter(ok).select(*cols)
        return s.withColumn("solve_idx", (F.row_number().over(user_window(params)) - 1).cast("long"))
    core = drop_halo(features).withColumn("_sv", ok.cast("int"))
    core = running_sum(core, "_sv", "_cs", params)
    cols = list(dict.fromkeys([HANDLE, PID, *params.order_by, SEG, IDX]))
    s = core.filter(ok).select(*cols, (F.col("_cs") - 1).cast("long").alias("solve_idx"))
    return resegment(s, "solve_idx", params, back=params.path_len, fwd=params.transition_window)


def transition_pairs(solved: DataFrame, params: Params = Params()) -> DataFrame:
    """(source, target, gap) for the next 1..window solves."""
    w = user_window(params, df=solved)
    nxt = F.array(*[F.lead(PID, g).over(w) for g in range(1, params.transition_window + 1)])
    keep = [HALO] if HALO in solved.columns else []
    s = drop_halo(solved.select(HANDLE, F.col(PID).alias("source_problem"), nxt.alias("_next"), *keep))
    s = s.select(HANDLE, "source_problem", F.posexplode("_next").alias("_pos", "target_problem"))
    return s.filter(F.col("target_problem").isNotNull()).select(
        HANDLE, "source_problem", "target_problem", (F.col("_pos") + 1).alias("gap_size"))


def transition_graph(features: DataFrame, params: Params = Params()) -> DataFrame:
    """Edge count and mean gap, kept at >= min count, probability within source.

    ``distinct_users`` (how many users make the transition) is reported but,
    as in the reference, the filter counts occurrences (D14)."""
    pairs = transition_pairs(solved_history(features, params), params)
    # by user first, where the rows already are; then one row per user and edge moves
    own = pairs.groupBy(HANDLE, "source_problem", "target_problem").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gap_size").alias("gaps"))
    edges = own.groupBy("source_problem", "target_problem").agg(
        F.sum("n").alias("transition_count"),
        (F.sum("gaps") / F.sum("n")).alias("avg_gap"),
        F.count(F.lit(1)).alias("distinct_users"),
    ).filter(F.col("transition_count") >= F.lit(params.min_transition_count))
    out_deg = Window.partitionBy("source_problem")
    return edges.withColumn("transition_probability",
                            F.col("transition_count") / F.sum("transition_count").over(out_deg))


def improvement_points(features: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows whose trailing ``past`` rating deltas sum to >= path_delta
    (bounded frames: works on a segmented frame; halo rows removed)."""
    d = features.withColumn("rating_delta", F.col(RATING) - F.lag(RATING, 1).over(user_window(params, df=features)))
    gain = full_window(F.sum, "rating_delta", trailing_frame(params, params.past, df=features), params.past)
    return strip(d.withColumn("improved_event", (gain >= F.lit(params.path_delta)).cast("int")))


def preceding_solves(features: DataFrame, params: Params = Params()) -> DataFrame:
    """For every improvement point, the last ``path_len`` solves with a time
    strictly earlier, as (handle, point time, problem) rows.

    A chain of ``path_len`` windows over the common order carries the latest
    solves before each row; the first row of a time has those with a smaller
    time, which all rows sharing it take. Every window has the rows' one order:
    no further exchange or sort, no join and no per-point rescan.
    """
    if is_segmented(features):
        return _preceding_solves_indexed(features, params)
    pts = improvement_points(features, params)
    solved = F.coalesce(F.col(VERDICT) == F.lit(OK), F.lit(False))
    before = user_window(params).rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<string>")
    pts = pts.withColumn("_prev", none)
    for _ in range(params.path_len):  # round i: the latest i solves before the row
        own = F.when(solved, F.concat(F.array(PID), F.coalesce("_prev", none)))
        pts = pts.withColumn("_prev", F.last(own, ignorenulls=True).over(before))
    rest = [c for c in params.order_by if c != TIME]
    if rest:
        same_time = Window.partitionBy(HANDLE, TIME).orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)
        pts = pts.withColumn("_prev", F.first("_prev").over(same_time))
    hits = pts.filter(F.col("improved_event") == 1)
    return hits.select(HANDLE, F.col(TIME).alias("point_time"), F.explode("_prev").alias(PID))


def _preceding_solves_indexed(features: DataFrame, params: Params) -> DataFrame:
    """P2 on a segmented frame, by equi-joins on exact indexes (no per-user window
    spans a whole history): c = number of the user's solves with a time before
    the point's (min of running count - own solve over the point's time group);
    the answer is the recent-solves array of solve c - 1."""
    ok = F.coalesce(F.col(VERDICT) == F.lit(OK), F.lit(False)).cast("int")
    core = running_sum(drop_halo(features).withColumn("_sv", ok), "_sv", "_cs", params)
    before_t = core.groupBy(HANDLE, TIME).agg(F.min(F.col("_cs") - F.col("_sv")).alias("_c"))
    solved = solved_history(features, params)
    sw = user_window(params, df=solved)
    recent = F.array(F.col(PID), *[F.lag(PID, i).over(sw) for i in range(1, params.path_len)])
    recent = drop_halo(solved.select(HANDLE, "solve_idx", F.filter(recent, lambda x: x.isNotNull()).alias("_prev"),
                                     HALO))
    pts = improvement_points(features, params).filter(F.col("improved_event") == 1).select(HANDLE, TIME)
    pts = pts.join(before_t, [HANDLE, TIME], "inner").filter(F.col("_c") >= 1)
    pts = pts.withColumn("solve_idx", (F.col("_c") - 1).cast("long"))
    hits = pts.join(recent, [HANDLE, "solve_idx"], "inner")
    return hits.select(HANDLE, F.col(TIME).alias("point_time"), F.explode("_prev").alias(PID))


def path_support(features: DataFrame, params: Params = Params()) -> DataFrame:
    """Support per problem >= minimum; confidence = support / max support."""
    sup = preceding_solves(features, params).groupBy(PID).agg(F.count(F.lit(1)).alias("support"))
    sup = sup.filter(F.col("support") >= F.lit(params.path_min_support))
    top = sup.agg(F.max("support")).scalar()
    return sup.withColumn("sequence_confidence", F.col("support") / top)


def path_patterns(features: DataFrame, params: Params = Params()) -> DataFrame:
    """X9: "after A and B, users often solve C": consecutive solve triples,
    support n(ABC) and confidence n(ABC) / n(AB)."""
    solved = solved_history(features, params)
    w = user_window(params, df=solved)
    keep = [HALO] if HALO in solved.columns else []
    tri = drop_halo(solved.select(F.col(PID).alias("first"), F.lead(PID, 1).over(w).alias("second"),
                                  F.lead(PID, 2).over(w).alias("third"), *keep))
    pairs = tri.filter(F.col("second").isNotNull()).groupBy("first", "second").agg(
        F.count(F.lit(1)).alias("pair_support"))
    triples = tri.filter(F.col("third").isNotNull()).groupBy("first", "second", "third").agg(
        F.count(F.lit(1)).alias("support")).filter(F.col("support") >= F.lit(params.pattern_min_support))
    out = triples.join(pairs, ["first", "second"], "inner")
    return out.select("first", "second", "third",
                      F.concat_ws(">", "first", "second", "third").alias("pattern"),
                      "support", (F.col("support") / F.col("pair_support")).alias("confidence"))


def _users(projected: DataFrame, least: int) -> DataFrame:
    """(pattern, support): users that have the pattern, where enough do. By user first, so a pattern
    that nearly all rows have is a row of each user."""
    own = projected.groupBy("pattern", HANDLE).agg(F.lit(1).alias("one"))
    return own.groupBy("pattern").agg(F.count("one").alias("support")).filter(F.col("support") >= F.lit(least))


def gapped_patterns(features: DataFrame, params: Params = Params()) -> DataFrame:
    """X9 with gaps: solve sequences of 2 to ``pattern_max_len`` problems that at least
    ``pattern_min_support`` users have, each member at most ``transition_window`` solves after the one
    before; support in users, confidence = support / support of the pattern without its last member.

    Projected-database mining (PrefixSpan): the database of a pattern is the places (user, solve) where
    it can end. Each place is extended by the solves after it, an equi-join on (user, solve) against one
    row each; places are kept once however many ways lead there, and infrequent patterns are dropped
    before they grow. Every level is written, so lineage stays short; rows per level are at most frequent
    patterns x solves, spread by user and place."""
    solved = solved_history(features, params)
    w = user_window(params, df=solved)
    keep = [HALO] if HALO in solved.columns else []
    after = F.array(*[F.struct(F.lead(PID, i).over(w).alias("item"), (F.col("solve_idx") + i).alias("at"))
                      for i in range(1, params.transition_window + 1)])
    steps = drop_halo(solved.select(HANDLE, F.col("solve_idx").alias("at"), F.col(PID).alias("item"), after.alias("next"), *keep))
    steps = materialize(steps.withColumn("next", F.filter("next", lambda x: x["item"].isNotNull())).filter(
        F.col("item").isNotNull()), "table")
    places = steps.select(F.array("item").alias("pattern"), HANDLE, "at")
    known = materialize(_users(places, params.pattern_min_support), "table")
    found = None
    for _ in range(2, params.pattern_max_len + 1):
        places = places.join(known.select("pattern"), "pattern", "left_semi").join(steps.select(HANDLE, "at", "next"), [HANDLE, "at"])
        places = places.select("pattern", HANDLE, F.explode("next").alias("n")).select(
            F.concat("pattern", F.array("n.item")).alias("pattern"), HANDLE, F.col("n.at").alias("at")).distinct()
        places = materialize(places, "table")
        longer = materialize(_users(places, params.pattern_min_support), "table")
        prefix = known.select(F.col("pattern").alias("_prefix"), F.col("support").alias("prefix_support"))
        rows = longer.withColumn("_prefix", F.slice("pattern", F.lit(1), F.size("pattern") - 1)).join(prefix, "_prefix")
        found = rows if found is None else found.unionByName(rows)
        known = longer
    return found.select(F.concat_ws(">", "pattern").alias("pattern"), F.size("pattern").alias("length"), "support",
                        "prefix_support", (F.col("support") / F.col("prefix_support")).alias("confidence"))
