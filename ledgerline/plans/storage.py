"""Tables that a job writes on its way: in the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset a temporary one, if Spark runs on this
    machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table: its lineage ends there and lost executors don't matter."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, path: str):
    """Hadoop's path and file system, to make a folder or see to its files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def in_order(df: DataFrame, by: list[str], path: str, files: int) -> None:
    """df as files of ranges of `by`, whose times of change follow the ranges: streams read files by that time."""
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.parquet(path)
    where, fs = folder(df.sparkSession, path)
    names = sorted(str(s.getPath()) for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    start = int(time.time() * 1000) - 1000 * len(names)
    for i, name in enumerate(names):
        fs.setTimes(folder(df.sparkSession, name)[0], start + 1000 * i, -1)
