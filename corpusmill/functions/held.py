"""Lineage cuts in the folder that all executors share, for tables that several branches or turns of a loop read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and the master is one machine's threads."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="corpusmill-held-")


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared one; it goes when the driver's Python ends."""
    uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, uri)
    return uri


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage; what is held goes when the driver's Python ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(spark))
        atexit.register(_remove, spark, sc._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager=True)
