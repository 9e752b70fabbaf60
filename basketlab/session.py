"""Session construction and the few session-level settings every job relies on."""
from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs assume: UTC wall-clock for all time math, ANSI arithmetic
# (so a bad cast fails instead of silently nulling), AQE for runtime re-planning
# (partition coalescing, skew-join splitting, runtime broadcast conversion).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting points for a large cluster (100 TB inputs): big initial shuffle
# partition count that AQE coalesces to ~256 MB per task, 256 MB scan splits,
# runtime broadcast only under a measured 64 MB, skew splitting of any shuffle
# partition 5x the median and above 512 MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app: str = "basketlab",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None, cluster: bool = False) -> SparkSession:
    """A session with the jobs' settings; ``cluster`` adds the large-cluster profile."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF) | (CLUSTER_CONF if cluster else {})
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    """Set the runtime SQL confs the jobs need on a session someone else built."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(k, DEFAULT_CONF[k])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring ``spark.checkpoint.dir``.

    On a cluster the folder must be the shared one the cluster names; only a
    local-mode session without that setting (tests, laptop runs) gets a fresh
    scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at the cluster's shared folder")
        configured = tempfile.mkdtemp(prefix="basketlab-ckpt-",
                                      dir=os.environ.get("BASKETLAB_SCRATCH"))
    sc.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of that name in the checkpoint folder, removed when the session ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove what a job wrote below ``shared_path`` and nothing reads any more."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs left in the driver (plans, broadcasts, shuffle files): a
    training makes hundreds of jobs, and the heap would grow to its limit before it is
    collected as a whole. Python's objects go first, as they hold the JVM's."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
