"""Problem metadata (M1-M7): difficulty by shrinkage, acceptance, quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip_keep_null, safe_div
from ..params import Params
from ..schema import OK, PID, PROBLEM_RATING, RATING, REQUIRED_METADATA_COLUMNS, VERDICT, require_columns


def problem_metadata(subs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per problem.

    A single grouped aggregate (partial aggregation before the shuffle, so a
    problem with a third of all rows costs one partial row per task).
    """
    solved = F.col(VERDICT) == F.lit(OK)
    stats = subs.groupBy(PID).agg(
        F.avg(PROBLEM_RATING).alias("avg_provided_rating"),
        F.avg(F.when(solved, F.col(RATING))).alias("avg_solver_rating"),
        F.count(VERDICT).alias("total_submissions"),
        F.count_if(solved).alias("ok_count"),
    )
    a = params.shrinkage_alpha
    provided, solver = F.col("avg_provided_rating"), F.col("avg_solver_rating")
    difficulty = (F.when(provided.isNotNull(), F.lit(a) * provided + F.lit(1 - a) * solver)
                  .otherwise(solver))
    acceptance = F.coalesce(safe_div("ok_count", "total_submissions"), F.lit(0.0))
    out = stats.select(
        PID,
        "avg_provided_rating",
        "avg_solver_rating",
        "total_submissions",
        "ok_count",
        (F.col("total_submissions") >= F.lit(params.min_support_submissions)).alias("has_sufficient_support"),
        clip_keep_null(difficulty, params.min_rating, params.max_rating).alias("estimated_difficulty"),
        acceptance.alias("acceptance_rate"),
        (acceptance >= F.lit(params.min_acceptance)).alias("stable_acceptance"),
    )
    return require_columns(out, REQUIRED_METADATA_COLUMNS, "problem metadata")


def metadata_summary(meta: DataFrame) -> DataFrame:
    """M7: total, supported and stable problem counts (one row)."""
    return meta.agg(
        F.count(F.lit(1)).alias("total_problems"),
        F.count_if("has_sufficient_support").alias("supported_problems"),
        F.count_if("stable_acceptance").alias("stable_acceptance_problems"),
    )
