"""Offline batch run and artefact loading.

``run_batch`` computes the artefacts stage by stage and writes each one as
Parquet; every later stage reads the written table back. That is the
reference's file boundary, and on a cluster it cuts lineage: a lost executor
re-runs only the stage it belonged to. ``load_artifacts`` reads them back for
serving, defaulting the optional ones.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.segments import is_segmented, strip
from ..operators import recommend as R
from ..params import Params
from ..schema import HANDLE
from ..sources.ingest import with_handle_bucket, write_lookup, write_table
from .analysis import Analysis

# artefact names (fixed: the reference's file names)
METADATA = "problem_metadata"
FEATURES = "user_features"
EFFECTS_DETAILED = "causal_att_effects_detailed"
EFFECTS = "causal_att_effects"
COHORTS = "cohort_examples"
SURVIVAL = "survival_effects"
GRAPH = "problem_graph"
PATHS = "sequence_patterns"
PLACEBO = "placebo_selection_bias"


def _stage(spark: SparkSession, a: Analysis, attr: str, out_dir: str, name: str,
           partition_by: list[str] | None = None, df: DataFrame | None = None) -> DataFrame:
    path = f"{out_dir.rstrip('/')}/{name}"
    df = getattr(a, attr) if df is None else df
    if name == FEATURES and not partition_by:
        # the windows dealt the rows by user already
        write_lookup(df, path, HANDLE, a.params.order_by, by_range=False)
    else:
        write_table(df, path, partition_by)
    back = spark.read.parquet(path)
    if partition_by:
        back = back.drop(*partition_by)
    a.__dict__[attr] = back  # later stages read the written table
    return back


def _stage_features(spark: SparkSession, a: Analysis, d: str, buckets: int | None) -> None:
    """Writes the features and makes every later stage read them: with heavy users from a table
    that keeps their segments and halo rows, else from the artefact itself."""
    if is_segmented(a.features_seq):
        seq = _stage(spark, a, "features_seq", d, FEATURES + "_segmented")
        a.__dict__["features"] = strip(seq)
    if buckets:
        _stage(spark, a, "features", d, FEATURES, ["handle_bucket"], with_handle_bucket(a.features, buckets))
    else:
        _stage(spark, a, "features", d, FEATURES)
    if not is_segmented(a.features_seq):
        a.__dict__["features_seq"] = a.features


def run_batch(spark: SparkSession, submissions: DataFrame, out_dir: str, params: Params = Params(),
              feature_buckets: int | None = None, recommendations: bool = True) -> dict[str, str]:
    """Write every artefact under ``out_dir``; returns name -> path.

    ``feature_buckets`` partitions the feature table by a hash bucket of the
    handle (the sink for very large feature tables).
    """
    a = Analysis(submissions, params)
    d = out_dir.rstrip("/")
    _stage(spark, a, "metadata", d, METADATA)
    _stage_features(spark, a, d, feature_buckets)
    _stage(spark, a, "effects", d, EFFECTS_DETAILED + "_all")
    _stage(spark, a, "att_significance", d, EFFECTS + "_all")
    _stage(spark, a, "att_significant", d, EFFECTS)
    a.__dict__.pop("significant_ids", None)
    _stage(spark, a, "att_detailed", d, EFFECTS_DETAILED)
    _stage(spark, a, "cohort_examples", d, COHORTS)
    _stage(spark, a, "survival_effects", d, SURVIVAL)
    _stage(spark, a, "transition_graph", d, GRAPH)
    _stage(spark, a, "path_support", d, PATHS)
    _stage(spark, a, "placebo_bias", d, PLACEBO)
    paths = {n: f"{d}/{n}" for n in (METADATA, FEATURES, EFFECTS_DETAILED, EFFECTS, COHORTS, SURVIVAL,
                                      GRAPH, PATHS, PLACEBO)}
    if recommendations:
        arts = load_artifacts(spark, d)
        cat = catalog_from_artifacts(arts)
        prof = R.user_profiles(arts[FEATURES], params)
        write_lookup(prof, f"{d}/user_profiles")
        write_table(R.recommendations(spark.read.parquet(f"{d}/user_profiles"), cat, params),
                    f"{d}/recommendations")
        paths.update(user_profiles=f"{d}/user_profiles", recommendations=f"{d}/recommendations")
    return paths


def _read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # only a path that isn't there means missing
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_artifacts(spark: SparkSession, out_dir: str) -> dict[str, DataFrame | None]:
    """Effects and metadata are required; survival, paths, cohorts and graph
    are optional (None when missing)."""
    d = out_dir.rstrip("/")
    arts = {n: _read_optional(spark, f"{d}/{n}") for n in (METADATA, FEATURES, EFFECTS, EFFECTS_DETAILED,
                                                            COHORTS, SURVIVAL, GRAPH, PATHS, PLACEBO)}
    for req in (EFFECTS, METADATA):
        if arts[req] is None:
            raise FileNotFoundError(f"required artefact missing: {d}/{req}")
    if arts[FEATURES] is not None and "handle_bucket" in arts[FEATURES].columns:
        arts[FEATURES] = arts[FEATURES].drop("handle_bucket")
    return arts


def catalog_from_artifacts(arts: dict[str, DataFrame | None], use_sequence: bool = True) -> DataFrame:
    """R1 from loaded artefacts: missing survival -> hazard 1.0, missing paths -> 0.0."""
    return R.recommender_catalog(arts[EFFECTS], arts[METADATA], arts[SURVIVAL],
                                 arts[PATHS] if use_sequence else None)
