"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_paths: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _own_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete every scratch table made so far; to be called once no result that reads one is needed any more."""
    while _paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps survive the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
