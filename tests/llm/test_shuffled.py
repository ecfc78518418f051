"""What is shuffled: whole rows once, and files that go with the job that needed them."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from risegraph.llm import ngram_join
from risegraph.llm.common import written, written_by_part

from .fixtures import documents

DOCS = "doc_id long, text string, _key string, _id string, _doc string"


def shuffled(spark):
    """Names of the shuffle files of this session."""
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for top in tops for p in Path(top.getPath()).rglob("shuffle_*")}


def test_shuffle_files_of_a_written_table_go(spark):
    before = shuffled(spark)
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).cast("int").alias("part")).agg(F.count("*").alias("n"))
    assert len(written(rows, "shuffled-test").collect()) == 7
    assert len(written_by_part(rows, "shuffled-test").collect()) == 7
    for _ in range(50):  # they go in the background
        left = {x for x in shuffled(spark) - before if x.endswith(".data")}
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_near_copies_move_whole_rows_once(spark):
    kept = ngram_join.drop_near_copies(documents(spark).withColumn("more", F.lit("x")))
    text = kept._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("LeftSemi")]
    assert "Window" in above and "Exchange" not in above


def test_near_copies_of_any_columns(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long, "a", "b", "c"), (1, long, "a", "b", "c"), (2, long, "d", "e", "f"), (None, long, "g", "h", "i"),
            (None, "", "j", "k", "l"), (None, "", "j", "k", "l"), (0, "", "m", "n", "o"), (3, None, "p", "q", "r"), (None, "un deux", "s", "t", "u")]
    kept = ngram_join.drop_near_copies(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "_key", "_id", "_doc"]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[0], *rows[4:]]))
