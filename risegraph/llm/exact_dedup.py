"""Exact deduplication by content sort.

The normalised texts are range-partitioned at splitters, the first ``SPLITTER`` characters of
sampled texts, and sorted on disk, so equal texts are neighbours; a window over the sorted rows
compares each text in full with the one before it and numbers the rows of a run: its first row
has the smallest id, and the run is the whole group of equal texts.

Only where one head (the first ``SPLITTER`` characters) holds more than a quarter of a partition's
even share of the rows would a task get too much: the rows of such hot heads, of which there are at
most four for each partition, are spread over ``SALTS`` runs of a text by a last part of the range
key. The first rows of these runs are then compared in full among themselves, in a second, small sort.

Defined cases: a null text is empty; a null id sorts after all others (a group of null ids only
keeps one row and has a null ``keep_id``); of rows that repeat id and text one is kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, whole_text, written

#: Runs over which the rows of one text of a hot head are spread.
SALTS = 64
#: Characters of a text that splitters hold: they are sampled to the driver, texts are not.
SPLITTER = 256
#: Rows below which no head is hot.
HOT_FROM = 64


def normalised(col: str) -> Column:
    return F.regexp_replace(whole_text(col), SPACE + "+", " ")


def _head(norm: Column) -> Column:
    return F.substring(norm, 1, SPLITTER)


def hot_heads(docs: DataFrame, text_col: str, hot_from: int = HOT_FROM) -> DataFrame:
    """Hashes of the heads that hold more than a quarter of a partition's even share of the rows;
    at most four times as many as shuffle partitions."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = max(hot_from, docs.count() // (4 * parts))
    heads = docs.groupBy(F.xxhash64(_head(normalised(text_col))).alias("_hot")).agg(F.count(F.lit(1)).alias("n"))
    return written(heads.filter(F.col("n") > most).select("_hot"), "exact-dedup-hot")


def sorted_runs(docs: DataFrame, id_col: str, text_col: str, salts: int = SALTS, hot_from: int = HOT_FROM) -> DataFrame:
    """One row per input row: its place in its run, the run's number, size and smallest id, the text's
    digest, whether its head is hot, and the whole text in the first row of a hot head's run (written)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("head", _head(F.col("norm")))
    hot = F.broadcast(hot_heads(docs, text_col, hot_from))
    rows = rows.join(hot, F.xxhash64("head") == F.col("_hot"), "left").withColumn("hot", F.col("_hot").isNotNull()).drop("_hot")
    # a cold text has one salt: all its rows are neighbours
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)))
    run = Window.partitionBy("head", "salt", "norm")  # equal texts have equal heads
    in_order = run.orderBy(F.col("doc_id").asc_nulls_last())
    rows = rows.repartitionByRange("head", "salt").withColumn("at", F.monotonically_increasing_id())
    rows = rows.select(
        "doc_id", "hot", F.row_number().over(in_order).alias("place"), F.min("at").over(run).alias("run"),
        F.min("doc_id").over(run).alias("run_min"), F.count(F.lit(1)).over(run).alias("run_size"),
        F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"), "norm")
    rows = rows.withColumn("norm", F.when(F.col("hot") & (F.col("place") == 1), F.col("norm")))
    return written(rows, "exact-dedup-runs")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                hot_from: int = HOT_FROM) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = sorted_runs(docs, id_col, text_col, salts, hot_from)
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    cold = runs.filter(~F.col("hot")).select(
        "doc_id", F.col("run_min").alias("keep_id"), F.col("run_size").alias("group_size"), (F.col("place") == 1).alias("kept"), sha)
    # first rows of the runs of one text, at most ``salts``, side by side and compared in full
    same = Window.partitionBy("norm")
    first = same.orderBy(F.col("run_min").asc_nulls_last(), "run")
    groups = runs.filter(F.col("hot") & (F.col("place") == 1)).select(
        F.col("run").alias("_run"), F.min("run_min").over(same).alias("keep_id"), F.sum("run_size").over(same).alias("group_size"),
        (F.row_number().over(first) == 1).alias("_first"))
    # by run, not by text: a frequent text joins in as many pieces as it has runs
    hot = runs.filter("hot").join(groups, F.col("run") == F.col("_run")).select(
        "doc_id", "keep_id", "group_size", (F.col("_first") & (F.col("place") == 1)).alias("kept"), sha)
    return cold.unionByName(hot)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    keyed = docs.withColumn("_digest", F.sha2(normalised(text_col), 256))
    stay = keyed.join(kept, keyed[id_col].eqNullSafe(kept["_id"]) & (keyed["_digest"] == kept["_sha"]), "left_semi")
    again = Window.partitionBy(id_col, "_digest").orderBy(F.lit(1))
    return stay.withColumn("_again", F.row_number().over(again)).filter("_again = 1").select(*docs.columns)


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""
