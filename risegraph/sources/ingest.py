"""Scans, cleaning, profiling and Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Params
from ..schema import (HANDLE, PID, PROBLEM_RATING, RATING, REQUIRED_SUBMISSION_COLUMNS, TIME,
                      VERDICT, require_columns)


def ingest(spark: SparkSession, source: str, target: str, fmt: str = "json",
           schema: T.StructType | None = None, **options) -> DataFrame:
    """Raw files of any Spark format -> Parquet; an existing target is left alone.

    ``mode("ignore")`` gives the reference's skip-if-present; the read is split
    into tasks by Spark, so no row buffering is needed. For a source that keeps
    growing, see ``risegraph.streaming.incremental_ingest``.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    reader.load(source).write.mode("ignore").parquet(target)
    return spark.read.parquet(target)


def clean_submissions(df: DataFrame, params: Params = Params()) -> DataFrame:
    """S3: required columns, standard types, rating present and within bounds.

    Problem ids become strings here so every artefact joins on the same type.
    """
    require_columns(df, REQUIRED_SUBMISSION_COLUMNS, "submissions")
    casts = {
        TIME: F.col(TIME).cast("long"),
        RATING: F.col(RATING).cast("double"),
        PID: F.col(PID).cast("string"),
        HANDLE: F.col(HANDLE).cast("string"),
        VERDICT: F.col(VERDICT).cast("string"),
    }
    if PROBLEM_RATING in df.columns:
        casts[PROBLEM_RATING] = F.col(PROBLEM_RATING).cast("double")
    else:
        casts[PROBLEM_RATING] = F.lit(None).cast("double")
    df = df.withColumns(casts)
    # between() is false for null, so a null rating drops itself
    return df.filter(F.col(RATING).between(F.lit(params.min_rating), F.lit(params.max_rating)))


def profile(df: DataFrame) -> DataFrame:
    """One row per column with null count, min and max (as strings) and the row count.

    A single aggregate over the table (partial aggregation per task), then an
    unpivot of that one row.
    """
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(df.columns):
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"n{i}"),
            F.min(c).cast("string").alias(f"lo{i}"),
            F.max(c).cast("string").alias(f"hi{i}"),
        ]
    one = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                 F.col(f"n{i}").alias("null_count"),
                 F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"))
        for i, c in enumerate(df.columns)
    ])).alias("s")
    return one.select(F.col("__n").alias("n_rows"), stack).select("n_rows", "s.*")


#: Tasks that write one partition of a sink.
SINK_SALTS = 4


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    """Parquet sink; optionally partitioned (e.g. by a handle hash bucket). A
    partitioned table is dealt by its partition columns and a salt of ``SINK_SALTS`` first,
    which bounds the files of each partition and splits a large one."""
    if partition_by:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SINK_SALTS))
        df = df.repartition(*partition_by, salt)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def with_handle_bucket(df: DataFrame, n_buckets: int, name: str = "handle_bucket") -> DataFrame:
    """Stable hash bucket of the handle, for partitioned feature sinks."""
    return df.withColumn(name, F.pmod(F.xxhash64(HANDLE), F.lit(n_buckets)).cast("int"))


def write_lookup(df: DataFrame, path: str, key: str = HANDLE, order: tuple[str, ...] = (), by_range: bool = True,
                 row_group_bytes: int = 16 << 20, expected_keys: int = 1_000_000, mode: str = "overwrite") -> str:
    """A sink for lookups by ``key``. Rows are dealt by ranges of (key, order) and sorted, so a
    key's rows lie side by side: the row groups' minima and maxima rule out all but one or two, and a
    Bloom filter of the key (sized for ``expected_keys`` in a row group) rules out gaps. A key that
    holds many rows is split over files by ``order``. ``by_range=False`` keeps the frame's own
    partitions (no further shuffle): a key is then in one file, and the Bloom filters rule out the others."""
    if by_range:
        df = df.repartitionByRange(key, *order)
    df = df.sortWithinPartitions(key, *order)
    w = df.write.mode(mode).option("parquet.block.size", row_group_bytes)
    w = w.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", expected_keys)
    w.parquet(path)
    return path


def read_keys(spark: SparkSession, path: str, keys: list, key: str = HANDLE) -> DataFrame:
    """The rows of some keys of a lookup table; the filter is pushed to its row groups."""
    return spark.read.parquet(path).filter(F.col(key).isin(*keys))
