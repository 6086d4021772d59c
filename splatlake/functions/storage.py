"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder where it is unset and driver and tasks are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="splatlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    The files are deleted when the application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, where = _at(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def put(spark: SparkSession, own: str, path: str) -> str:
    """Copy a file of the driver to a store; it is deleted when the application ends."""
    files, where = _at(spark, path)
    files.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{own}"), where)
    files.deleteOnExit(where)
    return path


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and nothing reads any more."""
    for table in tables:
        files, where = _at(table.sparkSession, table._written_to)
        files.delete(where, True)
