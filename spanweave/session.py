"""Session construction and shared-storage helpers."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "spanweave", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, sub: str) -> str:
    """A folder on the shared checkpoint storage named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage (HDFS/S3/a mounted disk)
    and must be there: without it this raises. In local mode (tests), where
    driver and tasks are one process, a fresh scratch folder is registered.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spanweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") + "/" + sub


def unique_dir(spark: SparkSession, sub: str) -> str:
    """A fresh sub-folder under :func:`shared_dir` (never reused between runs)."""
    import uuid
    return shared_dir(spark, f"{sub}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop FileSystem API (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that has not installed it."""
    import shutil
    import spanweave
    root = os.path.dirname(os.path.dirname(os.path.abspath(spanweave.__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spanweave-zip-"), "spanweave"), "zip", root, "spanweave")
    spark.sparkContext.addPyFile(archive)
