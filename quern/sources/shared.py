"""The folder that driver and executors share, and what is written there while a query is built."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one is made and set, but only if driver and executors are one process: elsewhere
    each executor would write to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; what is written there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df written once and read back: its lineage ends there, and what tasks numbered or drew stays as it was."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_remove)
