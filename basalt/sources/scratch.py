"""Where written intermediate tables go: the shared folder of the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a /tmp one where it is unset and everything runs in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/basalt-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root
