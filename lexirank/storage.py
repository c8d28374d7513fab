"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_announced: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of the session's warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate").rstrip("/")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path, whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under the session's own folder, which goes when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/lexirank/{spark.sparkContext.applicationId}"
    if own not in _announced:
        files, at = _files(spark, own)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _announced.add(own)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage is cut, a lost executor costs a file."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_written_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once nothing reads them any more."""
    for df in tables:
        path = df.__dict__.pop("_written_at", None)
        if path:
            files, at = _files(df.sparkSession, path)
            files.delete(at, True)
