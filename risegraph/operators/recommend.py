"""Catalog, profiles and ranked recommendations for every user at once
(R1-R8), the UI's derived fields (U1-U5), reachable-only and diverse variants
(X10, X12), and uplift by difficulty band / gap (X11).

Scale design of R3/R4: the score of a candidate does not depend on the user
and the band depends only on the user's integer rating, so the top-k is
computed once per distinct rating (at most max-min+1 = 3,201 values, a bound
set by cleaning) and users join their rating's list by equality. The band
[r - below, r + above] is an equi-join on difficulty buckets (each rating
explodes into the few buckets its band touches) plus an exact range re-check:
no nested-loop or cartesian join. Before it the catalog is cut to the top k of
each interval of ratings, which does not grow with the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from ..schema import HANDLE, PID, RATING
from ..functions.sequence import feature_names
from ..session import materialize

SCORE = "final_score"
_BUCKET = 200.0


def recommender_catalog(att_sig: DataFrame, metadata: DataFrame, survival: DataFrame | None = None,
                        paths: DataFrame | None = None) -> DataFrame:
    """Effects + survival (median, hazard) + metadata (difficulty, acceptance)
    + path confidence; hazard defaults to 1.0, sequence confidence to 0.0.
    Pass ``paths=None`` to reproduce a service that ignores the paths (D10)."""
    cat = att_sig.drop("estimated_difficulty")
    if survival is not None:
        cat = cat.join(survival.select(PID, "median_time_to_improve", "hazard_ratio"), PID, "left")
    else:
        cat = cat.withColumns({"median_time_to_improve": F.lit(None).cast("double"),
                               "hazard_ratio": F.lit(1.0)})
    if paths is not None:
        cat = cat.join(paths.select(PID, "sequence_confidence"), PID, "left")
    else:
        cat = cat.withColumn("sequence_confidence", F.lit(None).cast("double"))
    cat = cat.join(metadata.select(PID, "estimated_difficulty", "acceptance_rate"), PID, "left")
    cat = cat.withColumns({
        "sequence_confidence": F.coalesce(F.col("sequence_confidence").cast("double"), F.lit(0.0)),
        "hazard_ratio": F.coalesce(F.col("hazard_ratio"), F.lit(1.0)),
    })
    score = (F.col("att_score") * F.col("att_probability_uplift") * F.col("hazard_ratio")
             * (F.lit(1.0) + F.col("sequence_confidence")))
    # NaN would sort first on a descending order: make it null
    return cat.withColumn(SCORE, F.when(F.isnan(score), F.lit(None).cast("double")).otherwise(score))


def user_profiles(features: DataFrame, params: Params = Params()) -> DataFrame:
    """R2: latest state per user, by one grouped ``max_by`` (partial aggregation,
    no window, so a user with a third of all rows is still split across tasks)."""
    fn = feature_names(params)
    latest = F.max_by(F.struct(F.col(RATING).alias("r"), F.col(fn["acc"]).alias("a"),
                               F.col(fn["ok_diff"]).alias("d")),
                      F.struct(*params.order_by))
    g = features.groupBy(HANDLE).agg(latest.alias("_l"))
    return g.select(
        HANDLE,
        F.col("_l.r").cast("int").alias("current_rating"),
        F.lit("local_user").alias("rank"),
        F.bround(F.coalesce(F.col("_l.a"), F.lit(0.5)), 2).alias("recent_accuracy"),
        F.bround(F.coalesce(F.col("_l.d"), F.col("_l.r")), 1).alias("recent_avg_difficulty"),
    )


def _quality_floor(cat: DataFrame, params: Params) -> DataFrame:
    if params.min_att_score is not None:
        cat = cat.filter(F.col("att_score") >= F.lit(params.min_att_score))
    if params.min_probability_uplift is not None:
        cat = cat.filter(F.col("att_probability_uplift") >= F.lit(params.min_probability_uplift))
    return cat


def _suited(params: Params) -> tuple[F.Column, F.Column]:
    """The least and the greatest integer rating whose band holds the difficulty."""
    d = F.col("estimated_difficulty")
    return F.ceil(d - F.lit(params.band_above)), F.floor(d + F.lit(params.band_below))


def best_by_interval(catalog: DataFrame, params: Params, k: int, *extra: str) -> DataFrame:
    """The k best problems of each interval of ratings that they suit (and ``extra``). Problems
    of one interval are candidates of the same ratings, so no other can be in a top k; with
    ratings within the bounds of cleaning there are some 6,400 intervals, however many problems."""
    lo, hi = _suited(params)
    cat = catalog.filter(F.col("estimated_difficulty").isNotNull()).withColumns({"_lo": lo, "_hi": hi})
    w = Window.partitionBy("_lo", "_hi", *extra).orderBy(F.desc_nulls_last(SCORE), F.asc(PID))
    return cat.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r", "_lo", "_hi")


def band_candidates(ratings: DataFrame, catalog: DataFrame, params: Params = Params()) -> DataFrame:
    """(current_rating, catalog row) for difficulties in [r - below, r + above]."""
    b = F.lit(_BUCKET)
    cat = catalog.filter(F.col("estimated_difficulty").isNotNull()).withColumn(
        "_b", F.floor(F.col("estimated_difficulty") / b))
    r = F.col("current_rating")
    lo, hi = r - F.lit(params.band_below), r + F.lit(params.band_above)
    rb = ratings.select("current_rating", F.explode(F.sequence(F.floor(lo / b), F.floor(hi / b))).alias("_b"))
    j = rb.join(cat, "_b", "inner").drop("_b")
    return j.filter(F.col("estimated_difficulty").between(lo, hi))


def _top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(SCORE), F.asc(PID))
    return df.withColumn("rec_rank", F.row_number().over(w)).filter(F.col("rec_rank") <= k)


def recommendations_by_rating(ratings: DataFrame, catalog: DataFrame, params: Params = Params()) -> DataFrame:
    """R3-R4 per distinct rating: top k in band, or top k of all problems when
    the band is empty. The fallback list is the global top k, a scalar subquery
    (one array of k rows) attached to the ratings that need it."""
    catalog = _quality_floor(catalog, params)
    near = best_by_interval(catalog, params, params.top_k)
    inband = _top_k(band_candidates(ratings, near, params), "current_rating", params.top_k)
    inband = inband.withColumn("in_band", F.lit(True))
    cols = [c for c in catalog.columns]
    glob = catalog.orderBy(F.desc_nulls_last(SCORE), F.asc(PID)).limit(params.top_k)
    glob_arr = glob.agg(F.collect_list(F.struct(*cols)).alias("_a")).scalar()
    lacking = ratings.join(inband.select("current_rating").distinct(), "current_rating", "left_anti")
    fb = lacking.select("current_rating", F.posexplode(glob_arr).alias("_pos", "_c"))
    fb = fb.select("current_rating", *[F.col(f"_c.{c}").alias(c) for c in cols],
                   (F.col("_pos") + 1).alias("rec_rank"), F.lit(False).alias("in_band"))
    # the scalar list is in collect order; rank it again by score
    fb = _top_k(fb.drop("rec_rank"), "current_rating", params.top_k)
    return inband.unionByName(fb)


# fixed value: the sentence of an explanation
def explain_text() -> F.Column:
    """The explanation sentence."""
    return F.format_string(
        "Highly recommended (Score: %.1f). Causal Uplift: +%.1f points (p=%.4f). Solvers improve %.1fx faster.",
        F.col(SCORE), F.col("att_score"), F.col("p_value"), F.col("hazard_ratio"))


def recommendations(profiles: DataFrame, catalog: DataFrame, params: Params = Params()) -> DataFrame:
    """R3-R5, R8 for all users: rank, result fields, status ('no_match' when empty)."""
    ratings = profiles.select("current_rating").distinct()
    per_rating = recommendations_by_rating(ratings, catalog, params)
    shaped = per_rating.select(
        "current_rating", "rec_rank", "in_band",
        F.col(PID).alias("problem_id"),
        F.col("att_score").alias("uplift"),
        F.col("att_probability_uplift").alias("probability_uplift"),
        "p_value", "hazard_ratio",
        F.coalesce(F.col("median_time_to_improve").cast("double"), F.lit(-1.0)).alias("median_time_to_improve"),
        "estimated_difficulty",
        explain_text().alias("explanation"),
        F.col("total_treated_samples").alias("sample_size"),
        F.col(SCORE),
    )
    out = profiles.select(HANDLE, "current_rating").join(shaped, "current_rating", "left")
    return out.withColumn("status", F.when(F.col("problem_id").isNull(), F.lit("no_match"))
                          .otherwise(F.lit("success")))


def global_insights(catalog: DataFrame, k: int = 20) -> DataFrame:
    """Top k problems by ATT."""
    return (catalog.orderBy(F.desc_nulls_last("att_score"), F.asc(PID)).limit(k)
            .withColumnRenamed(PID, "problem_id"))


def problem_details(catalog: DataFrame, cohorts: DataFrame, graph: DataFrame,
                    params: Params = Params()) -> DataFrame:
    """R7 for all problems at once: stats + similar users + top next steps by
    transition probability (as ordered arrays; one row per problem)."""
    w = Window.partitionBy("source_problem").orderBy(F.desc("transition_probability"), F.asc("target_problem"))
    nxt = graph.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= params.next_steps_k)
    nxt = nxt.groupBy(F.col("source_problem").alias(PID)).agg(
        F.array_sort(F.collect_list(F.struct("_r", "target_problem", "transition_probability")))
        .alias("next_steps"))
    sim = cohorts.groupBy(PID).agg(
        F.array_sort(F.collect_list(F.struct(F.col("rating_gain") * -1, HANDLE, "rating_before",
                                             "rating_after", "rating_gain"))).alias("_u"))
    sim = sim.select(PID, F.transform("_u", lambda s: F.struct(s[HANDLE].alias(HANDLE),
                                                              s["rating_before"].alias("rating_before"),
                                                              s["rating_after"].alias("rating_after"),
                                                              s["rating_gain"].alias("rating_gain")))
                     .alias("similar_users"))
    return catalog.join(sim, PID, "left").join(nxt, PID, "left")


# ---------------------------------------------------------------- UI fields

# fixed values: rating tiers of the UI (lower bound, name), highest first
RATING_TIERS = [(3000, "legendary"), (2600, "grandmaster"), (2400, "master"), (1900, "candidate"),
                (1600, "expert"), (1400, "specialist"), (1200, "pupil")]
RATING_TIER_FLOOR = "newbie"


def rating_tier(c: F.Column) -> F.Column:
    expr = None
    for lo, name in RATING_TIERS:
        expr = F.when(c >= lo, F.lit(name)) if expr is None else expr.when(c >= lo, F.lit(name))
    return expr.otherwise(F.lit(RATING_TIER_FLOOR))


# fixed values: difficulty tiers of the UI
def difficulty_tier(c: F.Column) -> F.Column:
    """<= 1400 easy, <= 1700 medium, else hard."""
    return F.when(c <= 1400, F.lit("easy")).when(c <= 1700, F.lit("medium")).otherwise(F.lit("hard"))


def user_tiers(profiles: DataFrame) -> DataFrame:
    """U2."""
    return profiles.select(HANDLE, "current_rating", rating_tier(F.col("current_rating")).alias("rating_tier"))


def enrich(recs: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """title/tags from a problem dimension (id, title, tags as
    'a, b'), difficulty tier, impact flag, confidence label, day estimate,
    problem link parts."""
    if dimension is not None:
        dim = dimension.select(F.col(PID).cast("string").alias("problem_id"), "title", "tags")
        recs = recs.join(dim, "problem_id", "left")
    else:
        recs = recs.withColumns({"title": F.lit(None).cast("string"), "tags": F.lit(None).cast("string")})
    return recs.withColumns({
        "title": F.coalesce(F.col("title"), F.lit("Unknown Problem")),
        "tags": F.when(F.col("tags").isNull() | (F.col("tags") == ""), F.array().cast("array<string>"))
                 .otherwise(F.split(F.col("tags"), ", ")),
        "difficulty_tier": difficulty_tier(F.col("estimated_difficulty")),
        "high_impact": F.col("uplift") > 50,
        "confidence": F.when(F.col("p_value") < 0.001, F.lit("Very High")).otherwise(F.lit("High")),
        # U4: the UI's rough day estimate, median submissions / 10 (none when unknown)
        "days_to_improve": F.when(F.col("median_time_to_improve") >= 0,
                                  F.round(F.col("median_time_to_improve") / 10)),
        "contest_id": F.expr("substring(problem_id, 1, length(problem_id) - 1)"),
        "problem_index": F.expr("substring(problem_id, length(problem_id), 1)"),
    })


def user_potential(recs: DataFrame) -> DataFrame:
    """U4: total uplift and count of a user's recommendations, suggested range."""
    return recs.groupBy(HANDLE, "current_rating").agg(
        F.sum("uplift").alias("potential_gain"),
        F.count("problem_id").alias("n_recommended"),
    ).select(HANDLE, "current_rating", "potential_gain", "n_recommended",
             (F.col("current_rating") - 200).alias("range_low"),
             (F.col("current_rating") + 300).alias("range_high"))


# ---------------------------------------------------------------- X10-X12

def last_solves(features: DataFrame, params: Params = Params()) -> DataFrame:
    """Latest solved problem per user (grouped max_by, skew safe)."""
    from ..schema import OK, VERDICT
    s = features.filter(F.col(VERDICT) == F.lit(OK))
    return s.groupBy(HANDLE).agg(F.max_by(PID, F.struct(*params.order_by)).alias("last_solved"))


def _with_status(users: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Every user, with the recommendations of its key or one row of status 'no_match'."""
    out = users.join(per_key, keys, "left")
    return out.withColumn("status", F.when(F.col("problem_id").isNull(), F.lit("no_match")).otherwise(F.lit("success")))


def recommend_reachable(profiles: DataFrame, features: DataFrame, graph: DataFrame, catalog: DataFrame,
                        params: Params = Params()) -> DataFrame:
    """Candidates limited to the graph's next problems from the user's last
    solve, inside the band; top k. The score does not depend on the user, so the
    list is made once per (last solve, rating) and users join it by equality."""
    users = profiles.select(HANDLE, "current_rating").join(last_solves(features, params), HANDLE, "left")
    states = users.select("last_solved", "current_rating").distinct()
    edges = graph.select(F.col("source_problem").alias("last_solved"), F.col("target_problem").alias(PID))
    cat = _quality_floor(catalog, params).filter(F.col("estimated_difficulty").isNotNull())
    lo, hi = _suited(params)
    # of the next problems that suit the same ratings only the best k matter
    w = Window.partitionBy("last_solved", "_lo", "_hi").orderBy(F.desc_nulls_last(SCORE), F.asc(PID))
    nxt = edges.join(cat, PID, "inner").withColumns({"_lo": lo, "_hi": hi})
    nxt = nxt.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= params.top_k)
    cand = states.join(nxt, "last_solved", "inner").filter(F.col("current_rating").between(F.col("_lo"), F.col("_hi")))
    w = Window.partitionBy("last_solved", "current_rating").orderBy(F.desc_nulls_last(SCORE), F.asc(PID))
    top = cand.withColumn("rec_rank", F.row_number().over(w)).filter(F.col("rec_rank") <= params.top_k).select(
        "last_solved", "current_rating", "rec_rank", F.col(PID).alias("problem_id"), F.col("att_score").alias("uplift"), SCORE)
    return _with_status(users, top, ["last_solved", "current_rating"]).select(
        HANDLE, "current_rating", "last_solved", "rec_rank", "problem_id", "uplift", SCORE, "status")


def problem_tags(dimension: DataFrame) -> DataFrame:
    """(id, tag) of every problem of a dimension (id, title, tags as 'a, b'): each tag of it once."""
    tags = F.array_distinct(F.split(F.coalesce(F.col("tags"), F.lit("")), r",\s*"))
    rows = dimension.select(F.col(PID).cast("string").alias(PID), F.explode(tags).alias("tag"))
    return rows.select(PID, F.trim("tag").alias("tag")).filter(F.col("tag") != "").distinct()


def tag_index(dimension: DataFrame, catalog: DataFrame, params: Params = Params()) -> DataFrame:
    """The inverted index of tags: per tag its number of problems, how many of them the catalog holds,
    their mean uplift and the ``top_k`` best of them. The ranks of a tag that most problems have are
    limited in each task before they move."""
    rows = problem_tags(dimension).join(catalog.select(PID, "att_score", SCORE), PID, "left")
    per_tag = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n_problems"), F.count("att_score").alias("n_tested"),
                                      F.avg("att_score").alias("mean_uplift"))
    w = Window.partitionBy("tag").orderBy(F.desc_nulls_last(SCORE), F.asc(PID))
    best = rows.filter(F.col("att_score").isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= params.top_k)
    best = best.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("_r", PID))).alias("_b"))
    return per_tag.join(best, "tag", "left").select(
        "tag", "n_problems", "n_tested", "mean_uplift",
        F.coalesce(F.transform("_b", lambda x: x[PID]), F.array().cast("array<string>")).alias("best_problems"))


def recommend_diverse(profiles: DataFrame, catalog: DataFrame, params: Params = Params(),
                      dimension: DataFrame | None = None) -> DataFrame:
    """In-band top k in which no tag occurs more than ``params.max_per_tag`` times; all tags of a
    problem count, its difficulty tier where it has none.

    Greedy re-ranking, made per distinct rating (a bounded number): in each of the k rounds a rating
    takes the best candidate all of whose tags still have room, one aggregate with partial maxima. The
    state of a rating is the list of its picks and their tags. Of the candidates that suit the same
    ratings and have the same tags only the best ``max_per_tag`` can be picked; the others are left out
    before the ratings are joined."""
    cat = _quality_floor(catalog, params)
    tier = F.array(difficulty_tier(F.col("estimated_difficulty")))
    if dimension is not None:
        tags = problem_tags(dimension).groupBy(PID).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        cat = cat.drop("tags").join(tags, PID, "left").withColumn("tags", F.coalesce("tags", tier))
    else:
        cat = cat.withColumn("tags", tier)
    ratings = profiles.select("current_rating").distinct()
    cand = band_candidates(ratings, best_by_interval(cat, params, params.max_per_tag, "tags"), params)
    order = F.struct(F.col(SCORE).isNull().alias("none"), (-F.col(SCORE)).alias("s"), F.col(PID).alias("p"))
    cand = materialize(cand.select("current_rating", PID, "tags", SCORE, order.alias("_order")), "table")
    picks = "array<struct<problem_id: string, tags: array<string>, final_score: double>>"
    state = ratings.withColumn("_picked", F.array().cast(picks))
    for _ in range(params.top_k):
        used = F.flatten(F.transform("_picked", lambda x: x["tags"]))
        taken = F.transform("_picked", lambda x: x["problem_id"])
        now = state.select("current_rating", "_picked", used.alias("_used"), taken.alias("_taken"))
        # one row per rating on the state's side
        j = cand.join(now, "current_rating").filter(~F.array_contains("_taken", F.col(PID)) & F.forall(
            "tags", lambda t: F.size(F.filter("_used", lambda u: u == t)) < params.max_per_tag))
        best = j.groupBy("current_rating").agg(F.min_by(F.struct(F.col(PID).alias("problem_id"), "tags", F.col(SCORE).alias("final_score")),
                                                        F.col("_order")).alias("_best"))
        state = state.join(best, "current_rating", "left").select("current_rating", F.when(
            F.col("_best").isNotNull(), F.concat("_picked", F.array("_best"))).otherwise(F.col("_picked")).alias("_picked"))
        state = materialize(state, "table")  # a row per rating; the rounds' plans stay short
    top = state.select("current_rating", F.posexplode("_picked").alias("_pos", "p")).select(
        "current_rating", (F.col("_pos") + 1).alias("rec_rank"), "p.problem_id", F.col("p.tags")[0].alias("primary_tag"),
        F.array_join("p.tags", ",").alias("tags"), F.col("p.final_score").alias(SCORE))
    return _with_status(profiles.select(HANDLE, "current_rating"), top, ["current_rating"])


def uplift_by_band(catalog: DataFrame, width: float = 100.0) -> DataFrame:
    """X11: mean ATT per difficulty band."""
    band = (F.floor(F.col("estimated_difficulty") / F.lit(width)) * F.lit(width)).cast("int")
    return catalog.filter(F.col("estimated_difficulty").isNotNull()).groupBy(band.alias("difficulty_band")).agg(
        F.avg("att_score").alias("mean_uplift"), F.count(F.lit(1)).alias("problems"))


def uplift_by_gap(effects: DataFrame, metadata: DataFrame, params: Params = Params(),
                  width: float = 100.0) -> DataFrame:
    """X11: treated-weighted uplift by (difficulty - state rating) gap band."""
    e = effects.join(metadata.select(PID, "estimated_difficulty"), PID, "inner")
    gap = F.col("estimated_difficulty") - F.col("bin_rating") * F.lit(params.rating_bin)
    e = e.withColumn("gap_band", (F.floor(gap / F.lit(width)) * F.lit(width)).cast("int"))
    n = F.col("treated_count")
    return e.filter(F.col("gap_band").isNotNull()).groupBy("gap_band").agg(
        (F.sum(F.col("uplift") * n) / F.sum(n)).alias("mean_uplift"),
        F.sum(n).alias("treated_samples"), F.count(F.lit(1)).alias("cells"))
