"""Session helpers shared by tests, the bench and the driver entry."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# Spark 4.1 may treat a union of equally partitioned inputs as partitioned itself; together with reused
# exchanges in a self-join that returned rows twice here. The jobs do not rely on it.
SAFE_CONF = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.session.timeZone": "UTC"}


def make_safe(spark: SparkSession) -> SparkSession:
    for key, value in SAFE_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "lorebank") -> SparkSession:
    """A session for one machine; a cluster brings its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return make_safe(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint root.

    ``spark.checkpoint.dir`` names storage every executor can reach. Only a ``local`` master, whose
    executors share the driver's disk, may do without: a temporary folder stands in. Elsewhere this is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        import uuid

        return os.path.join(root, f"lorebank-{name}-{uuid.uuid4().hex}")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    return tempfile.mkdtemp(prefix=f"spark-{name}-", dir="/tmp")
