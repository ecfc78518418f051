"""Session construction, the shared checkpoint folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "risegraph", extra_conf: dict | None = None) -> SparkSession:
    """A session with AQE, skew-join handling and UTC; UI off.

    On a cluster pass ``master=None`` and let spark-submit decide everything
    else; ``shuffle_partitions`` then stays at the cluster's setting.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # let AQE coalesce the partitions of cached tables too (performance only)
        "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # long DAGs print long plans; cap the string kept for explain/events
        "spark.sql.maxPlanStringLength": str(4 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra_conf or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from the SparkContext or ``spark.checkpoint.dir``; only a local-mode
    session without either gets a private folder (tests).
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="risegraph-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/risegraph-tables/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, mode: str = "persist") -> DataFrame:
    """Compute ``df`` once for several consumers.

    ``"persist"``: cached on executors (memory, spilling to disk); a lost
    executor's blocks are recomputed from lineage. ``"checkpoint"``: written to
    the shared checkpoint folder, cutting lineage (for long DAGs and
    stage-by-stage batch runs). ``"table"``: the same as Parquet, so that readers
    prune columns and push filters down.
    """
    if mode == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if mode == "persist":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if mode == "table":
        path = scratch_path(df.sparkSession, "materialized")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    if mode in ("none", None, False):
        return df
    raise ValueError(f"unknown materialize mode {mode!r}")


def row_width(df: DataFrame) -> int:
    """Estimated bytes of a row in memory: 8 per number, 64 per string or other value."""
    fixed = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}
    return 16 + sum(8 if kind in fixed else 64 for _, kind in df.dtypes)


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = 128 << 20) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows and about ``max_bytes`` bytes.

    The table is cached and counted (one job, a count per task); above a bound it
    is released and the planner / AQE chooses a shuffled join, so a table that
    grows with the data can never be shipped whole to every executor.
    """
    m = materialize(df, "persist")
    n = m.count()
    if n <= max_rows and n * row_width(df) <= max_bytes:
        return F.broadcast(m), True
    m.unpersist()
    return df, False
