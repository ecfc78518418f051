"""Named reports over the shared test tables (the keys of ``__spark_entry__``).

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame with doubles
rounded to 6 places. The submissions view comes from ``events``
(SURVEY §5.1); cell minimums are 5 (``params.SMALL``) because the reference's
50 leaves nothing at small scale. Everything else uses the reference values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_doubles
from ..params import SMALL, Params
from ..schema import HANDLE, PID, SUBMISSIONS
from ..session import scratch_path
from ..sources.adapters import (LINEITEM_ORDER, load_events_dimension, load_events_submissions,
                                load_lineitem_submissions)
from ..sources.ingest import ingest, profile, write_lookup
from ..operators import recommend as R
from . import batch
from .analysis import Analysis

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def analysis(spark: SparkSession, sf_dir: str, params: Params = SMALL, materialize: bool = False) -> Analysis:
    return Analysis(load_events_submissions(spark, sf_dir), params, materialize=materialize)


def register(name: str, materialize: bool = False):
    """``materialize`` for reports that read many artefacts (see ``Analysis``)."""
    def deco(fn: Callable[[Analysis], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(analysis(spark, sf_dir, materialize=materialize)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


def register_plain(name: str):
    """For reports that take ``(spark, sf_dir)`` themselves."""
    def deco(fn: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---------------------------------------------------------------- S / M / F
@register("clean_submissions")
def _clean(a: Analysis) -> DataFrame:
    """S3 at the contract's bounds."""
    return a.submissions


@register("profile_submissions")
def _profile(a: Analysis) -> DataFrame:
    return profile(a.submissions)


@register("problem_metadata")
def _meta(a: Analysis) -> DataFrame:
    return a.metadata


@register("metadata_summary")
def _meta_summary(a: Analysis) -> DataFrame:
    return a.metadata_summary


@register("user_features")
def _features(a: Analysis) -> DataFrame:
    return a.features


@register_plain("ingested_submissions")
def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as raw JSON files, ingested to Parquet and cleaned."""
    raw = scratch_path(spark, "raw-submissions")
    load_events_submissions(spark, sf_dir).write.json(raw)
    return Analysis(ingest(spark, raw, scratch_path(spark, "ingested"), "json", SUBMISSIONS)).submissions


@register("stored_features")
def _stored_features(a: Analysis) -> DataFrame:
    """The features read back from their lookup table."""
    spark, path = a.features.sparkSession, scratch_path(a.features.sparkSession, "features")
    write_lookup(a.features, path, HANDLE, a.params.order_by, by_range=False)
    return spark.read.parquet(path)


@register_plain("stored_catalog")
def _stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artefact written by the batch run, loaded again, and the catalog made of them."""
    path = scratch_path(spark, "artefacts")
    batch.run_batch(spark, load_events_submissions(spark, sf_dir), path, SMALL, recommendations=False)
    return batch.catalog_from_artifacts(batch.load_artifacts(spark, path))


# ---------------------------------------------------------------- C
@register("outcome_gain")
def _outcome(a: Analysis) -> DataFrame:
    return a.outcomes.select("handle", "time", PID, "future_rating_20", "rating_gain_20", "improved_20")


@register("state_bins")
def _bins(a: Analysis) -> DataFrame:
    return a.cem.groupBy("bin_rating", "bin_acc", "bin_diff").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("rating_gain_20").alias("mean_gain"))


@register("cem_baseline")
def _baseline(a: Analysis) -> DataFrame:
    return a.baseline


@register("cem_treated")
def _treated(a: Analysis) -> DataFrame:
    return a.treated


@register("cem_effects")
def _effects(a: Analysis) -> DataFrame:
    return a.effects


@register("att_effects")
def _att(a: Analysis) -> DataFrame:
    return a.att


@register("att_significance")
def _att_sig(a: Analysis) -> DataFrame:
    return a.att_significance


@register("att_significant")
def _att_significant(a: Analysis) -> DataFrame:
    return a.att_significant


@register("cohort_examples")
def _cohorts(a: Analysis) -> DataFrame:
    return a.cohort_examples


@register("att_detailed")
def _detailed(a: Analysis) -> DataFrame:
    return a.att_detailed


# ---------------------------------------------------------------- X statistics
@register("att_bonferroni")
def _bonf(a: Analysis) -> DataFrame:
    return a.att_bonferroni


@register("att_cohens_d")
def _cohen(a: Analysis) -> DataFrame:
    return a.att_cohens_d


@register("welch_stats")
def _welch(a: Analysis) -> DataFrame:
    return a.welch_stats


@register("att_intervals")
def _ci(a: Analysis) -> DataFrame:
    return a.att_intervals


@register("balance_check")
def _balance(a: Analysis) -> DataFrame:
    return a.balance_check


@register("att_effects_solvers")
def _solvers(a: Analysis) -> DataFrame:
    return a.att_effects_solvers


@register("propensity_strata")
def _strata(a: Analysis) -> DataFrame:
    return a.propensity_strata


@register("propensity_effects")
def _propensity(a: Analysis) -> DataFrame:
    return a.propensity_effects


# ---------------------------------------------------------------- T
@register("survival_rows")
def _surv_rows(a: Analysis) -> DataFrame:
    return a.survival_rows.select("handle", "time", PID, "is_solve", "rating_at_solve",
                                  "submission_idx", "improved_event")


@register("survival_pairs")
def _surv_pairs(a: Analysis) -> DataFrame:
    return a.survival_pairs


@register("survival_effects")
def _surv(a: Analysis) -> DataFrame:
    return a.survival_effects


@register("time_quantiles")
def _tq(a: Analysis) -> DataFrame:
    return a.time_quantiles


@register("time_to_improve")
def _tti(a: Analysis) -> DataFrame:
    return a.time_to_improve


@register("kaplan_meier")
def _km(a: Analysis) -> DataFrame:
    return a.kaplan_meier


# ---------------------------------------------------------------- G / P / X9
@register("transition_graph")
def _graph(a: Analysis) -> DataFrame:
    return a.transition_graph


@register("improvement_points")
def _points(a: Analysis) -> DataFrame:
    return a.improvement_points.filter(F.col("improved_event") == 1).select(
        "handle", "time", PID, "rating_at_submission")


@register("path_support")
def _paths(a: Analysis) -> DataFrame:
    return a.path_support


@register("path_patterns")
def _patterns(a: Analysis) -> DataFrame:
    return a.path_patterns


@register("gapped_patterns")
def _gapped(a: Analysis) -> DataFrame:
    return a.gapped_patterns


# ---------------------------------------------------------------- V / X6 / X7
@register("placebo_bias")
def _placebo(a: Analysis) -> DataFrame:
    return a.placebo_bias


@register("placebo_summary")
def _placebo_summary(a: Analysis) -> DataFrame:
    return a.placebo_summary


@register("pre_trend")
def _pre_trend(a: Analysis) -> DataFrame:
    return a.pre_trend


@register("random_placebo")
def _random_placebo(a: Analysis) -> DataFrame:
    return a.random_placebo


# ---------------------------------------------------------------- R / U / X10-X12
@register("recommender_catalog", materialize=True)
def _catalog(a: Analysis) -> DataFrame:
    return a.catalog(significant_only=False)


@register("user_profiles")
def _profiles(a: Analysis) -> DataFrame:
    return a.profiles


@register("recommendations", materialize=True)
def _recs(a: Analysis) -> DataFrame:
    """Reference catalog: significant problems only (p < 0.01)."""
    return a.recommendations(significant_only=True)


@register("recommendations_all", materialize=True)
def _recs_all(a: Analysis) -> DataFrame:
    """Catalog of every tested problem, so most users have in-band candidates."""
    return a.recommendations(significant_only=False)


@register("global_insights", materialize=True)
def _insights(a: Analysis) -> DataFrame:
    return R.global_insights(a.catalog(significant_only=True), a.params.top_att)


def _whole(c: F.Column, scale: int = 1) -> F.Column:
    return F.round(c * scale).cast("long").cast("string")


@register("problem_details", materialize=True)
def _details(a: Analysis) -> DataFrame:
    """All of a problem's catalog columns, its cohort as handle:before:after:gain and its next
    steps as problem:probability in millionths."""
    d = R.problem_details(a.catalog(significant_only=True), a.cohort_examples, a.transition_graph, a.params)
    return d.withColumns({
        "similar_users": F.concat_ws(",", F.transform("similar_users", lambda s: F.concat_ws(
            ":", s["handle"], _whole(s["rating_before"]), _whole(s["rating_after"]), _whole(s["rating_gain"])))),
        "next_steps": F.concat_ws(",", F.transform("next_steps", lambda s: F.concat_ws(
            ":", s["target_problem"], _whole(s["transition_probability"], 1_000_000)))),
    })


@register("recommendations_enriched", materialize=True)
def _enriched(a: Analysis) -> DataFrame:
    e = R.enrich(a.recommendations(significant_only=False))
    return e.select("handle", "rec_rank", "problem_id", "title", F.size("tags").alias("n_tags"),
                    "difficulty_tier", "high_impact", "confidence", "days_to_improve", "contest_id",
                    "problem_index")


@register_plain("problem_dimension")
def _dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_events_dimension(spark, sf_dir)


@register_plain("tag_index")
def _tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir, materialize=True)
    t = R.tag_index(load_events_dimension(spark, sf_dir), a.catalog(significant_only=False), a.params)
    return t.withColumn("best_problems", F.array_join("best_problems", ","))


@register_plain("recommendations_titled")
def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 with a problem dimension: titles and tags of every recommendation."""
    a = analysis(spark, sf_dir, materialize=True)
    e = R.enrich(a.recommendations(significant_only=False), load_events_dimension(spark, sf_dir))
    return e.select("handle", "rec_rank", "problem_id", "title", F.array_join("tags", ",").alias("tags"),
                    F.size("tags").alias("n_tags"), "difficulty_tier")


@register_plain("recommend_diverse_tags")
def _diverse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12 over all tags of the problem dimension."""
    a = analysis(spark, sf_dir, materialize=True)
    return R.recommend_diverse(a.profiles, a.catalog(significant_only=False), a.params, load_events_dimension(spark, sf_dir))


@register("user_tiers")
def _tiers(a: Analysis) -> DataFrame:
    return R.user_tiers(a.profiles)


@register("user_potential", materialize=True)
def _potential(a: Analysis) -> DataFrame:
    return R.user_potential(a.recommendations(significant_only=False))


@register("recommend_reachable", materialize=True)
def _reachable(a: Analysis) -> DataFrame:
    return R.recommend_reachable(a.profiles, a.features, a.transition_graph,
                                 a.catalog(significant_only=False), a.params)


@register("recommend_diverse", materialize=True)
def _diverse(a: Analysis) -> DataFrame:
    return R.recommend_diverse(a.profiles, a.catalog(significant_only=False), a.params).drop("tags")


@register("uplift_by_band", materialize=True)
def _by_band(a: Analysis) -> DataFrame:
    return R.uplift_by_band(a.catalog(significant_only=False))


@register("uplift_by_gap")
def _by_gap(a: Analysis) -> DataFrame:
    return R.uplift_by_gap(a.effects, a.metadata, a.params)


# ---------------------------------------------------------------- lineitem at the reference's thresholds
def _lineitem(spark: SparkSession, sf_dir: str, materialize: bool = False) -> Analysis:
    return Analysis(load_lineitem_submissions(spark, sf_dir), Params(order_by=LINEITEM_ORDER), materialize=materialize)


@register_plain("li_att_significance")
def _li_att(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C9 of the lineitem log with cells of at least 50 rows."""
    return _lineitem(spark, sf_dir).att_significance


@register_plain("li_placebo_bias")
def _li_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).placebo_bias


@register_plain("li_survival_effects")
def _li_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).survival_effects


@register_plain("li_transition_graph")
def _li_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).transition_graph


@register_plain("li_recommendations")
def _li_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir, materialize=True).recommendations(significant_only=False)
