"""The artefact DAG: submissions -> metadata -> features -> {cohorts, survival,
graph, paths, placebo} -> catalog -> recommendations.

``Analysis`` builds each artefact lazily as a DataFrame (nothing is collected).
The only eager steps are size checks before a broadcast: the table is persisted,
counted, and broadcast only within ``params.broadcast_max_rows`` and
``params.broadcast_max_bytes``; otherwise it is released and the planner/AQE
picks a shuffled join. ``run_batch`` writes every artefact as Parquet, which also cuts
lineage between stages so a lost executor re-runs only its own stage.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..functions.segments import halo_width, index_hot_users, is_segmented, strip, with_halo
from ..operators import matching as C
from ..operators import paths as G
from ..operators import placebo as V
from ..operators import propensity as X
from ..operators import recommend as R
from ..operators import survival as S
from ..operators.features import user_features
from ..operators.metadata import metadata_summary, problem_metadata
from ..params import Params
from ..schema import PID
from ..session import broadcast_if_small, materialize
from ..sources.ingest import clean_submissions


class Analysis:
    """Artefacts of one submissions log.

    ``materialize`` keeps the artefacts that several consumers read (features,
    cohort effects, survival, paths, graph, catalog, profiles) computed once.
    ``True`` caches the features, which keep their partitioning and order by user, and
    writes the small artefacts as Parquet to the shared checkpoint folder, so the plans of their
    consumers start from scans; ``"persist"`` caches all, ``"checkpoint"`` and ``"table"`` write
    all there, ``False`` leaves every consumer its own plan (best for a single report).
    The cohort cells are written once in any case.
    """

    def __init__(self, submissions: DataFrame, params: Params = Params(), clean: bool = True,
                 materialize: bool | str = False):
        self.params = params
        self._raw = submissions
        self._clean = clean
        self.materialize = materialize
        self._catalogs: dict = {}

    def _m(self, df: DataFrame, large: bool = False) -> DataFrame:
        if not self.materialize:
            return df
        if self.materialize is True:
            return materialize(df, "persist" if large else "table")
        return materialize(df, self.materialize)

    # ------------------------------------------------------------ inputs
    @cached_property
    def submissions(self) -> DataFrame:
        return clean_submissions(self._raw, self.params) if self._clean else self._raw

    def small(self, df: DataFrame) -> DataFrame:
        """Size-checked broadcast of a table that grows with the number of problems."""
        return broadcast_if_small(df, self.params.broadcast_max_rows, self.params.broadcast_max_bytes)[0]

    # ------------------------------------------------------------ metadata
    @cached_property
    def metadata(self) -> DataFrame:
        return self._m(problem_metadata(self.submissions, self.params))

    @cached_property
    def metadata_summary(self) -> DataFrame:
        return metadata_summary(self.metadata)

    @cached_property
    def difficulty(self) -> DataFrame:
        return self.small(self.metadata.select(PID, "estimated_difficulty"))

    # ------------------------------------------------------------ features
    @cached_property
    def sequenced(self) -> DataFrame:
        """Submissions with heavy users' histories cut into segments plus halo
        rows (unchanged when no user is above ``params.hot_user_rows``)."""
        back, fwd = halo_width(self.params)
        hot = self.params.hot_user_rows
        if hot is None or self.max_history <= hot:
            return self.submissions  # nobody is heavy: plain per-user windows
        # heavy users' rows are pinned by a checkpoint inside the index (a
        # compact scan); other users' rows stay a lazy read of the input
        return with_halo(index_hot_users(self.submissions, self.params), self.params, back, fwd)

    @cached_property
    def features_seq(self) -> DataFrame:
        """Features on the segmented frame (for operators with bounded frames).

        With heavy users present the features are written once as Parquet under
        the shared checkpoint folder: every consumer starts from them, so the windows run
        once and each consumer's plan starts from a compact scan."""
        f = user_features(self.sequenced, self.difficulty, self.params)
        if is_segmented(f):
            return materialize(f, "table")
        return self._m(f, large=True)

    @cached_property
    def features(self) -> DataFrame:
        return strip(self.features_seq)

    # ------------------------------------------------------------ cohorts
    @cached_property
    def outcomes(self) -> DataFrame:
        return strip(C.with_outcome(self.features_seq, self.params))

    @cached_property
    def cem(self) -> DataFrame:
        return C.with_state_bins(self.outcomes, self.params)

    @cached_property
    def cells(self) -> DataFrame:
        """Written once: every cohort report reads this small table."""
        return C.written_cells(self.cem, self.params)

    @cached_property
    def baseline(self) -> DataFrame:
        return C.cem_baseline(self.cells, self.params)

    @cached_property
    def treated(self) -> DataFrame:
        return C.cem_treated(self.cells, self.params)

    @cached_property
    def effects(self) -> DataFrame:
        return self._m(C.cem_effects(self.cells, self.params))

    @cached_property
    def att(self) -> DataFrame:
        return C.att_effects(self.effects)

    @cached_property
    def att_significance(self) -> DataFrame:
        return C.with_significance(self.att)

    @cached_property
    def att_significant(self) -> DataFrame:
        return C.significant(self.att_significance, self.params)

    @cached_property
    def significant_ids(self) -> DataFrame:
        return self.small(self.att_significant.select(PID))

    @cached_property
    def cohort_examples(self) -> DataFrame:
        return C.cohort_examples(self.outcomes, self.significant_ids, self.params)

    @cached_property
    def att_detailed(self) -> DataFrame:
        return C.att_detailed(self.effects, self.significant_ids)

    # ------------------------------------------------------------ statistics
    @cached_property
    def att_bonferroni(self) -> DataFrame:
        return C.att_bonferroni(self.att_significance, self.params)

    @cached_property
    def att_cohens_d(self) -> DataFrame:
        return C.att_cohens_d(self.effects)

    @cached_property
    def welch_stats(self) -> DataFrame:
        return C.welch_stats(self.effects)

    @cached_property
    def att_intervals(self) -> DataFrame:
        return C.with_intervals(self.att_significance, self.params)

    @cached_property
    def balance_check(self) -> DataFrame:
        return C.balance_check(self.cem, self.effects, self.params)

    @cached_property
    def att_effects_solvers(self) -> DataFrame:
        return C.att_effects_solvers(self.cem, self.params)

    # ------------------------------------------------------------ propensity strata
    @cached_property
    def propensity_strata(self) -> DataFrame:
        return X.propensity_strata(self.cells, self.params)

    @cached_property
    def propensity_effects(self) -> DataFrame:
        return X.propensity_effects(self.propensity_strata, self.params)

    # ------------------------------------------------------------ survival
    @cached_property
    def survival_rows(self) -> DataFrame:
        return S.survival_rows(self.features_seq, self.params)

    @cached_property
    def survival_pairs(self) -> DataFrame:
        return S.survival_pairs(self.survival_rows)

    @cached_property
    def survival_effects(self) -> DataFrame:
        return self._m(S.survival_effects(self.survival_pairs, self.params))

    @cached_property
    def time_quantiles(self) -> DataFrame:
        return S.time_quantiles(self.survival_pairs)

    @cached_property
    def max_history(self) -> int:
        """Longest user history in the raw input: one scalar aggregate that reads
        only the handle column. Cleaning only removes rows, so it bounds the
        cleaned histories too; it decides heavy-user splitting and the number
        of block levels of the time-to-improve search."""
        from pyspark.sql import functions as F
        n = self._raw.select("handle").groupBy("handle").count().agg(F.max("count")).first()[0]
        return int(n or 0)

    @cached_property
    def time_to_improve(self) -> DataFrame:
        return S.time_to_improve(self.features_seq, self.params, block=1024,
                                 levels=S.levels_for(self.max_history, 1024))

    @cached_property
    def kaplan_meier(self) -> DataFrame:
        return S.kaplan_meier(self.time_to_improve, time_col="duration")

    # ------------------------------------------------------------ graph and paths
    @cached_property
    def transition_graph(self) -> DataFrame:
        return self._m(G.transition_graph(self.features_seq, self.params))

    @cached_property
    def improvement_points(self) -> DataFrame:
        return G.improvement_points(self.features_seq, self.params)

    @cached_property
    def path_support(self) -> DataFrame:
        return self._m(G.path_support(self.features_seq, self.params))

    @cached_property
    def path_patterns(self) -> DataFrame:
        return G.path_patterns(self.features_seq, self.params)

    @cached_property
    def gapped_patterns(self) -> DataFrame:
        return G.gapped_patterns(self.features_seq, self.params)

    # ------------------------------------------------------------ placebo
    @cached_property
    def placebo_bias(self) -> DataFrame:
        return V.placebo_bias(self.features_seq, self.params)

    @cached_property
    def placebo_summary(self) -> DataFrame:
        return V.placebo_summary(self.placebo_bias)

    @cached_property
    def pre_trend(self) -> DataFrame:
        return V.pre_trend(self.features_seq, self.params)

    @cached_property
    def random_placebo(self) -> DataFrame:
        return V.random_placebo(self.features_seq, self.metadata, self.params)

    # ------------------------------------------------------------ recommender
    def catalog(self, significant_only: bool = True, use_sequence: bool = True) -> DataFrame:
        key = (significant_only, use_sequence)
        if key not in self._catalogs:
            eff = self.att_significant if significant_only else self.att_significance
            self._catalogs[key] = self._m(R.recommender_catalog(
                eff, self.metadata, self.survival_effects, self.path_support if use_sequence else None))
        return self._catalogs[key]

    @cached_property
    def profiles(self) -> DataFrame:
        return self._m(R.user_profiles(self.features, self.params))

    def recommendations(self, significant_only: bool = True) -> DataFrame:
        return R.recommendations(self.profiles, self.catalog(significant_only), self.params)
