"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table, not by caching: a lost executor then costs a re-read, never a failed job. The tables
belong to the session: the file system removes them when it is closed, and ``discard`` removes one that is no longer read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, but only for a local master: on a cluster a
    machine-local folder would not be seen by the other executors, so that case is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftara-"))
    return sc.getCheckpointDir().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def child(spark: SparkSession, parent, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent, name)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at yet; what is written there goes when the session ends."""
    path = f"{shared_dir(spark)}/siftara-{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more; anything else that a table reads is left alone."""
    for df in tables:
        spark = df.sparkSession
        own = f"{shared_dir(spark)}/siftara-"
        for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, p = file_system(spark, place)
            if p.toUri().getPath().startswith(file_system(spark, own)[1].toUri().getPath()):
                fs.delete(p, True)
