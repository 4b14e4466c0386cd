"""Tables that cut lineage, in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local master, whose tasks share the
    driver's disk, gets a folder of its own; on a cluster it must be set."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A new empty folder within the shared one. It goes, with what is in it, when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _hadoop(spark, path)
    fs.delete(at, True)


def materialize(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Writes df once to the shared folder (in folders by column values, if by names any) and reads it back: cuts lineage, and fixes rows
    that a retried task would otherwise number anew. The files go when the session ends or by discard."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(f"{path}/rows")
    back = spark.read.schema(df.schema).parquet(f"{path}/rows")
    _PATHS[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize that nothing reads any longer."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            remove(df.sparkSession, path)
