"""Session settings and the shared folder for data that must outlive a task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "tidemark", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session with the settings the operators are written for.

    ``cpus`` asks for a local session of that many threads. Left out, master and sizes come from
    the cluster's own configuration.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A skewed join is split even where the split costs one more shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.driver.memory", memory)
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the cluster's shared folder (``spark.checkpoint.dir``).

    A local session without that setting gets a new temporary folder, since its executors share
    the driver's disk. A cluster without it is an error: a folder only one machine sees would
    lose the data with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
