"""Lineage cuts. Broadcasts are left to the planner, which knows sizes in bytes
(``spark.sql.autoBroadcastJoinThreshold`` and its adaptive twin)."""
from __future__ import annotations

from pyspark.sql import DataFrame

from basketlab.session import shared_path


def materialize(df: DataFrame, name: str = "frame") -> DataFrame:
    """Cut lineage by writing the frame as a Parquet table into the cluster's
    checkpoint folder (shared storage, survives executor loss; never a local
    checkpoint) and reading it back. One computation, columnar storage, and the
    planner gets real file-size statistics for its join choices."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
