"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every geolex job relies on.  AQE re-plans joins from runtime
# sizes (a checked broadcast: small sides are broadcast only after their
# shuffle stage has been measured) and splits skewed partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def cluster_conf(shuffle_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large input: enough shuffle partitions that each holds
    about ``partition_bytes`` of the largest shuffle (AQE coalesces small
    ones), at least three tasks per core, 256 MB file splits, and AQE skew
    splitting for partitions five times the median."""
    parts = max(cores * 3, -(-shuffle_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "geolex", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, shared by driver and executors.

    Only a local session that has none gets a temporary folder; on a cluster
    a missing setting is an error, because each executor would write to its
    own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="geolex-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Session setting: tasks to spread a text scan over before it is tokenised.
TEXT_PARTITIONS = "spark.geolex.text.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a text scan over the number of tasks the caller has set.

    For tables stored as a few large row groups, whose tokenisation would
    run in a few tasks.  Unset, scans keep their splits: a large input on a
    cluster has enough of them.  Round-robin repartitioning is deterministic
    (Spark sorts first), so a re-run task gets the same rows.
    """
    n = df.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


#: Stored bytes of a table to each task that takes its rows apart and aggregates the parts: words of compressed
#: text need some 70 times their stored size in the hash maps of an aggregate.
TASK_BYTES = 4 << 20


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for a stored table, in proportion to its size, so that a task's memory does not grow with
    it; no fewer than the session's cores or than the caller has set for text."""
    spark = df.sparkSession
    stored = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get(TEXT_PARTITIONS, None) or 1),
               -(-stored // task_bytes))


_cuts: list[str] = []


def remember_cut(path: str) -> str:
    """``path``, which ``remove_cuts`` will delete."""
    _cuts.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` now and cut its lineage: parquet under the shared checkpoint
    folder, read back (survives executor loss, unlike a local checkpoint, and
    its size is known to the planner).  ``remove_cuts`` deletes the tables."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    remember_cut(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` has written so far; call it when the
    results that read them have been stored.  Returns their number."""
    n = len(_cuts)
    while _cuts:
        path = spark._jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
