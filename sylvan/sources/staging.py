"""Written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables of a session, the same on any master.

    It lies in the folder that the cluster names for checkpoints, or else in
    the warehouse: both are shared between driver and executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/sylvan-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table that several later steps read, and return the written one.

    Later steps then neither repeat the work nor lose it with an executor. The
    job that writes it runs at once; ``clear`` removes all tables of a session.
    """
    target = f"{folder or shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def clear(spark: SparkSession, folder: str | None = None) -> None:
    """Remove the intermediate tables of this session; results that still read them are void."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder or shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
