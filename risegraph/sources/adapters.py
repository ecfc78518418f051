"""Submissions views derived from the shared test tables.

No shared table is a submissions log, so these adapters derive one with Spark
(the oracle SQL derives the same rows with DuckDB).

* ``submissions_from_events``: one row per event; the rating is an integer
  random walk with a planted effect of four problems, so the matched-cohort
  estimates have something to find.
* ``submissions_from_lineitem``: the heavier bench input, one row per line
  item, handle = supplier, problem = part brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.segments import index_hot_users, running_sum, strip
from ..params import Params
from ..schema import HANDLE, PID, PROBLEM_RATING, RATING, TIME, VERDICT
from ..session import broadcast_if_small, materialize


# fixed values of the events adapter: rating step by event type and by k % 10
EVENT_STEP = {"purchase": 25, "signup": 10, "view": 0, "click": -10}
EVENT_STEP_OTHER = -25
K_STEP = {0: 40, 1: 20, 8: -20, 9: -40}
SOLVED_EVENTS = ("purchase", "signup")
UNRATED_K = 7

# lineitem order key, unique per supplier at every scale
LINEITEM_ORDER = ("time", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def epoch_micros(ts) -> F.Column:
    """Microseconds since 1970-01-01 of a timestamp_ntz, independent of the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.col(ts).cast("timestamp_ntz"))


def _case(col: F.Column, mapping: dict, default) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None
                else expr.when(col == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def submissions_from_events(events: DataFrame, params: Params = Params()) -> DataFrame:
    """``params`` supplies only the heavy-user thresholds of the walk."""
    params = params.with_(order_by=(TIME, "kk", "event_type"))
    kk = F.get_json_object("props", "$.k").cast("int") % 10
    e = events.select(
        F.col("user_id").cast("string").alias(HANDLE),
        epoch_micros("ts").alias(TIME),
        "event_type",
        kk.alias("kk"),
    )
    step = _case(F.col("event_type"), EVENT_STEP, EVENT_STEP_OTHER) + _case(F.col("kk"), K_STEP, 0)
    e = _walk(e.withColumn("step", step), params)
    return e.select(
        HANDLE,
        TIME,
        F.concat(F.lit("P"), F.lpad(F.col("kk").cast("string"), 2, "0")).alias(PID),
        F.when(F.col("event_type").isin(*SOLVED_EVENTS), F.lit("OK"))
         .otherwise(F.lit("WRONG_ANSWER")).alias(VERDICT),
        RATING,
        F.when(F.col("kk") == UNRATED_K, F.lit(None).cast("double"))
         .otherwise((F.lit(1000) + F.lit(100) * F.col("kk")).cast("double")).alias(PROBLEM_RATING),
    )


def _walk(df: DataFrame, params: Params) -> DataFrame:
    """rating = 1500 + sum of the steps of the user's earlier rows: a running
    sum that stays parallel for heavy users (``segments.running_sum``)."""
    df = running_sum(index_hot_users(df, params), "step", "_cum", params)
    df = df.withColumn(RATING, (F.lit(1500) + F.col("_cum") - F.col("step")).cast("double"))
    return strip(df).drop("_cum", "step")


def _view(df: DataFrame) -> DataFrame:
    """The derived view is read by several jobs of one analysis (size checks,
    then the main plan): cache it so the scan, join and walk run once. A
    production log is a Parquet table and needs no such view."""
    return materialize(df, "persist")


def load_events_submissions(spark: SparkSession, sf_dir: str, params: Params = Params()) -> DataFrame:
    return _view(submissions_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), params))


# fixed values of the lineitem adapter: brand effects on the rating walk
BRAND_STEP = {"Brand#11": 15, "Brand#12": 8, "Brand#54": -8, "Brand#55": -15}
UNRATED_BRAND = "Brand#33"


def submissions_from_lineitem(lineitem: DataFrame, part: DataFrame, params: Params = Params()) -> DataFrame:
    """handle = supplier, problem = part brand, verdict OK unless returned,
    rating = 1500 + running sum of (discount points - 5) + a brand effect."""
    # what depends on the brand is worked out once per part
    brand_no = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    brands = part.select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias(PID), _case(F.col("p_brand"), BRAND_STEP, 0).alias("_effect"),
        F.when(F.col("p_brand") == UNRATED_BRAND, F.lit(None).cast("double"))
         .otherwise((F.lit(800) + F.lit(40) * brand_no).cast("double")).alias(PROBLEM_RATING))
    brands, _ = broadcast_if_small(brands, params.broadcast_max_rows)
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                         "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    d = li.join(brands, "l_partkey", "left").select(
        F.col("l_suppkey").cast("string").alias(HANDLE),
        epoch_micros("l_shipdate").alias(TIME),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.coalesce(F.col(PID), F.lit("Brand#00")).alias(PID),
        F.when(F.col("l_returnflag") == "R", F.lit("WRONG_ANSWER")).otherwise(F.lit("OK")).alias(VERDICT),
        (F.round(F.col("l_discount") * 100).cast("int") - F.lit(5) + F.coalesce(F.col("_effect"), F.lit(0))).alias("step"),
        PROBLEM_RATING,
    )
    return _walk(d, params.with_(order_by=LINEITEM_ORDER))


def load_lineitem_submissions(spark: SparkSession, sf_dir: str, params: Params = Params()) -> DataFrame:
    return _view(submissions_from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
                                           spark.read.parquet(f"{sf_dir}/part.parquet"), params))


#: Tags that a derived problem has.
DIMENSION_TAGS = 3


def problem_dimension(parts: DataFrame, problem: F.Column, tags: int = DIMENSION_TAGS) -> DataFrame:
    """(id, title, tags 'a, b') of the problems that ``parts`` (of the shared tables) are dealt to: the
    title is the name of the first part, the tags are the most frequent words of its parts' names
    and types (ties by word). Counted partially in each task; ranked on one row per problem and word."""
    p = parts.select(problem.alias(PID), "p_partkey", "p_name", "p_type")
    titles = p.groupBy(PID).agg(F.min_by("p_name", F.struct("p_partkey", "p_name")).alias("title"))
    words = p.select(PID, F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("tag"))
    words = words.filter(F.col("tag") != "").groupBy(PID, "tag").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(PID).orderBy(F.desc("n"), F.asc("tag"))
    words = words.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= tags)
    listed = words.groupBy(PID).agg(F.array_sort(F.collect_list(F.struct("r", "tag"))).alias("t"))
    listed = listed.select(PID, F.array_join(F.transform("t", lambda x: x["tag"]), ", ").alias("tags"))
    return titles.join(listed, PID, "left")


def load_events_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and tags of the events adapter's problems: part k belongs to problem k % 10."""
    kk = (F.col("p_partkey") % 10).cast("string")
    return problem_dimension(spark.read.parquet(f"{sf_dir}/part.parquet"), F.concat(F.lit("P"), F.lpad(kk, 2, "0")))


def load_lineitem_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and tags of the lineitem adapter's problems, the brands."""
    return problem_dimension(spark.read.parquet(f"{sf_dir}/part.parquet"), F.coalesce(F.col("p_brand"), F.lit("Brand#00")))
