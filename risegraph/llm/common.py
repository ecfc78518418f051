"""Small helpers shared by the operators: word rules, written intermediate tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space that separates words, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(col: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: For rows of megabytes: pages and row groups are closed by size after any row, not after a hundred, which
#: would be unpacked whole; zstd holds no buffers of a page's size outside the heap.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
              "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
              "parquet.block.size": str(16 << 20), "compression": "zstd"}


#: What was shuffled for a written table is not read again: its files go with the job, not when the driver
#: happens to collect its garbage.
_SHUFFLED_GOES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: computed once, lineage cut,
    safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    with _settings(df.sparkSession, _SHUFFLED_GOES):
        df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a row number under its part.
ROW_BITS = 40


def written_by_part(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a table bucketed by its column ``part``, of which each task has one value: a join
    on (part, row) then moves the other side only."""
    spark = df.sparkSession
    table = f"t_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with _settings(spark, _SHUFFLED_GOES):
        df.write.format("parquet").options(**(options or {})).option("path", scratch_path(spark, name)).bucketBy(buckets, "part").saveAsTable(table)
    return spark.table(table)


@contextmanager
def _settings(spark: SparkSession, own: dict[str, str]):
    old = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def arrow_rows(spark: SparkSession, rows: int):
    """Rows with large values go to Python so many at a time; for plans run inside."""
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def joined_in_place(spark: SparkSession, batch_rows: int = 1000):
    """Lets joins on (part, row) keep the partitioning by part, and rows with large values go to
    Python in small batches; for plans run inside."""
    return _settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false",
                             "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)})


def fetched(stored: DataFrame, wanted: DataFrame, row: str, *columns: Column) -> DataFrame:
    """``wanted`` with ``columns`` of the row of ``stored`` that its column ``row`` numbers."""
    small = wanted.select("*", F.shiftright(row, ROW_BITS).cast("int").alias("_part")).hint("shuffle_hash")
    big = stored.select(F.col("part").alias("_at"), F.col("row").alias("_row"), *columns)
    return big.join(small, (F.col("_at") == F.col("_part")) & (F.col("_row") == F.col(row))).drop("_at", "_row", "_part")
