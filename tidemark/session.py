"""Session settings the operators rely on, and the shared folder for intermediate data."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone: wall-clock arithmetic below assumes instants are shown in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the one given with ``setCheckpointDir``.

    If neither is set, a session within one process uses its warehouse; a cluster has to name a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


#: This process's own folder below the shared one; removed when the process ends.
RUN = f"run-{uuid.uuid4().hex}"
_removed_at_exit: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder, kept until this process ends."""
    root = f"{shared_dir(spark)}/tidemark/{RUN}"
    if root not in _removed_at_exit:
        _removed_at_exit.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give ``checkpoint()`` and the tree learners a reliable folder if none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/tidemark-checkpoints")
