"""Lineage cuts into the cluster's shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a ``local*`` master without the setting (tests, benchmarks) gets a
    scratch folder: on a cluster the executors would write to their own
    disks, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="terrapix-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/terrapix/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing
    upstream shuffles) and pins non-deterministic columns such as
    ``spark_partition_id()`` so every consumer sees the same values.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrapix_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``materialize`` that nothing reads any more."""
    path = getattr(df, "_terrapix_path", None)
    if path:
        remove_path(df.sparkSession, path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries made and run inside drop their shuffle files as they end.

    For results that are written or collected once: running the same
    DataFrame again would make its shuffles anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the file system that serves it."""
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Exception):  # cleaning up must not fail a finished job
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
