"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, but only if all tasks run in the driver's process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='asofline-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends or by clear()."""
    path = f"{shared_folder(spark).rstrip('/')}/asofline/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def clear() -> None:
    """Remove what was written to the paths of new_path()."""
    while _made:
        spark, path = _made.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; the folder is the cluster's to clean then
            return


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again, which cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
