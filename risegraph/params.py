"""All tunable thresholds in one frozen dataclass.

Every operator takes ``params: Params = Params()``. The defaults are the
values the reference computes with; tests and small scale factors override
only the sample-size minimums (cells thin out on small data).
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # --- fixed values that must equal the reference for equal results -------
    # rating bounds kept by cleaning and used to clip difficulty
    min_rating: float = 800.0
    max_rating: float = 4000.0
    # rows of history for the rolling features, outcome shift, placebo lag
    history: int = 20
    future: int = 20
    past: int = 20
    # rows with fewer than this many submissions in the history are dropped
    min_submissions: int = 10
    # state bins: rating / 100, accuracy * 10, difficulty / 200
    rating_bin: float = 100.0
    acc_bin_scale: float = 10.0
    diff_bin: float = 200.0
    # matched cohorts
    min_samples: int = 50
    min_treated_prefilter: int = 10
    uplift_cap: float = 300.0
    p_threshold: float = 0.01
    top_att: int = 20
    cohort_k: int = 5
    # problem metadata
    shrinkage_alpha: float = 0.7
    min_support_submissions: int = 50
    min_acceptance: float = 0.05
    # time to improvement
    survival_delta: float = 50.0
    min_survival_samples: int = 20
    # transition graph
    transition_window: int = 5
    min_transition_count: int = 10
    next_steps_k: int = 5
    # improvement paths
    path_delta: float = 100.0
    path_len: int = 3
    path_min_support: int = 30
    # fewest occurrences of a reported solve pattern
    pattern_min_support: int = 5
    # longest gapped solve pattern (X9); consecutive members are at most transition_window solves apart
    pattern_max_len: int = 3
    # placebo
    placebo_min_count: int = 20
    # recommender: candidate band [rating - below, rating + above], top k
    band_below: float = 200.0
    band_above: float = 400.0
    top_k: int = 5
    # most recommendations that share a primary tag
    max_per_tag: int = 2
    # optional quality floors (defined by the reference, unused there): None = off
    min_att_score: float | None = None
    min_probability_uplift: float | None = None
    # --- engine choices -----------------------------------------------------
    # tie mode of the bin rounding: "up" = half away from zero, "even" = banker's
    tie_mode: str = "up"
    # total order of a user's history: rows equal in all of these are interchangeable
    order_by: tuple[str, ...] = ("time", "id_of_submission_task", "verdict", "rating_at_submission", "problem_rating")
    # pre-trend lags (X6) and the two-sided critical value for 99 % intervals
    pre_trend_lags: tuple[int, ...] = (5, 10, 15, 20)
    ci_z: float = 2.5758293035489004
    # largest table, in rows and in estimated bytes, that is broadcast after a size check
    broadcast_max_rows: int = 2_000_000
    broadcast_max_bytes: int = 128 << 20
    # users above this many rows get their history cut into segments of
    # segment_rows rows (None: never); see functions.segments
    hot_user_rows: int | None = 5_000_000
    segment_rows: int = 1_000_000
    # rows per range partition when heavy users are indexed (fewer, larger
    # partitions than segments keep the shuffle's bookkeeping small)
    index_partition_rows: int = 8_000_000

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


# thresholds used by the registered test queries: the reference's
# 50-row cell minimum leaves nothing at sf0.01, so cells need only 5 rows there.
SMALL = Params(min_samples=5, min_treated_prefilter=5)
